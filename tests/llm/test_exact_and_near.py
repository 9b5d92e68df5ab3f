"""Chunk recipes and SimHash components next to plain Python."""

import hashlib
import itertools

import pytest
import xxhash
from pyspark.sql import functions as F

import odd_rows
from siftmark.llm import components, exact_dedup, simhash
from siftmark.session import materialize


def squeezed(text):
    return b"".join((text or "").encode().split()).decode()


def exact_by_hand(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(squeezed(text), []).append((-len(text or ""), i is None, i))
    out = []
    for i, text in rows:
        own = groups[squeezed(text)]
        keep = min(own, key=lambda x: (x[0], x[1], x[2] or 0))[2]
        out.append((i, keep, len(own), i == keep, hashlib.sha256(squeezed(text).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("buckets", [None, 7])
def test_exact_groups(spark, buckets):
    pick = {"chunk_hash": lambda c: F.pmod(F.xxhash64(c), F.lit(buckets))} if buckets else {}
    found = exact_dedup.exact_groups(odd_rows.frame(spark), **pick)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == exact_by_hand([r[:2] for r in odd_rows.rows()])
    assert exact_dedup.exact_groups(odd_rows.empty(spark)).collect() == []


def test_chunks_cover_the_text(spark):
    row = spark.createDataFrame([("Ab. " * 3000 + "x" * 9000 + "😀" * 5000 + ".\n",)], "text string")
    parts, whole = row.select(
        F.regexp_extract_all(exact_dedup.normalised(F.col("text")), F.lit(exact_dedup.CHUNK), F.lit(0)),
        exact_dedup.normalised(F.col("text")),
    ).first()
    assert "".join(parts) == whole
    assert max(map(len, parts)) <= exact_dedup.MOST


def print_of(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def reach(prints):
    """Root of every fingerprint, by comparing all."""
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in itertools.combinations(list(root), 2):
        if (a ^ b).bit_count() <= 2:
            root[find(a)] = find(b)
    return {p: find(p) for p in root}


@pytest.mark.parametrize("large", [128, 1])
def test_near_duplicates(spark, large):
    rows = [r[:2] for r in odd_rows.rows()]
    prints = [print_of(t) for _, t in rows]
    roots = reach(set(prints))
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    want = sorted(((i, p, least.get(roots[p])) for (i, _), p in zip(rows, prints)), key=repr)
    found = simhash.near_duplicates(odd_rows.frame(spark), large=large).collect()
    assert sorted(((r[0], r[1] % 2**64, r[2]) for r in found), key=repr) == want
    assert simhash.near_duplicates(odd_rows.empty(spark)).collect() == []


@pytest.mark.parametrize("large", [128, 3])
def test_links_reach_all_pairs_within_two_bits(spark, large):
    base = 0x0123456789ABCDEF
    prints = {base} | {base ^ (1 << i) for i in range(0, 64, 5)} | {base ^ (3 << i) for i in range(0, 60, 7)}
    prints |= {base ^ (1 << i) ^ (1 << (i + 33) % 64) for i in range(0, 64, 9)} | {base ^ 0xFF << i for i in (0, 8, 50)}
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    edges = simhash.links(spark.createDataFrame(signed, "fingerprint long"), large)
    roots = {r.node % 2**64: r.root % 2**64 for r in components.components(edges).collect()}
    want = reach(prints)
    for a, b in itertools.combinations(prints, 2):
        assert (roots.get(a, a) == roots.get(b, b)) == (want[a] == want[b])


@pytest.fixture
def plans(monkeypatch):
    """Final plans of the tables that near dedup stores, by label, as they are made."""
    found = {}

    def stored(df, label):
        df.collect()
        found.setdefault(label, []).append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, label)

    monkeypatch.setattr(simhash, "materialize", stored)
    monkeypatch.setattr(components, "materialize", stored)
    return found


@pytest.mark.parametrize("large", [128, 2])
def test_near_dedup_broadcasts_no_table_that_grows(spark, plans, large):
    """Neither exploded variants nor stars nor edges: all are small here, and would be broadcast."""
    base = 0x0123456789ABCDEF
    prints = [(base ^ (1 << i),) for i in range(40)] + [(3**i,) for i in range(1, 39)]
    edges = simhash.links(spark.createDataFrame(prints, "fingerprint long"), large)
    assert components.components(edges).where("root <> node").count() >= 39
    found = simhash.near_duplicates(odd_rows.frame(spark), large=large)
    found.collect()
    plans["result"] = [found._jdf.queryExecution().executedPlan().toString()]
    assert {"shared-variants", "edges", "roots", "result"} <= set(plans)
    for label, some in plans.items():
        for plan in some:
            assert "Broadcast" not in plan, label


def test_fingerprints_are_dealt_before_they_become_many(spark, plans):
    simhash.links(spark.range(300).selectExpr("id AS fingerprint"))
    assert "REPARTITION_BY_NUM" in plans["shared-variants"][0]


def test_components_of_a_chain(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (150, 200)]
    edges = spark.createDataFrame(chain, "a long, b long")
    found = {r.node: r.root for r in components.components(edges).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 150: 100, 200: 100}
