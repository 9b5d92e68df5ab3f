"""Packing and mixing: exact round trips and sums."""

import random
import zlib
from bisect import insort

import numpy as np
import odd_rows
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftmark.llm import common, mixing, packing, queries
from siftmark.llm.word_ids import WordIds

JSON = queries.tokenizer_json()
ALPHABET = [
    "%%%", "#", "(", ")", "@x.", "-", "é.", "ó,", "ж!", "<|", ">", "İ.",
    "the", "The", "É", "é", "é", "́", ".", ",", "…", "'s", "'S", "don't", "12", "<|endoftext|>", "<|ENDOFTEXT|>",
    "|>", " ", "  ", "\n", " ", "　", "İ", "ß", "K", "你好", "。", "😀", "_", "ſ", "ﬁ", "x!?|", "\t", "Σ", "ς", "\x1c",
]


def test_ids_of_words_are_ids_of_the_text():
    rng = random.Random(2)
    whole, ids = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), WordIds(JSON)
    for _ in range(3000):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 12)))
        words = ids.words(text.encode())
        found = np.frombuffer(ids.ids([words])[0], "<u4").tolist()
        assert found == whole.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packed_pieces(spark, capacity):
    rows = [r[:2] for r in odd_rows.rows()]
    whole = Tokenizer.from_str(JSON)
    want = []
    for i, text in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want.append((i, piece, at, len(part), zlib.crc32(part.tobytes())))
    found = packing.packed_pieces(odd_rows.frame(spark), JSON, capacity).collect()
    assert sorted((tuple(r)[:5] for r in found), key=repr) == sorted(want, key=repr)
    bins = {}
    for r in found:
        insort(bins.setdefault(r.sequence_id, []), (r.offset, r.length))
    for pieces in bins.values():
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
        assert sum(n for _, n in pieces) <= capacity
    assert packing.packed_pieces(odd_rows.empty(spark), JSON, capacity).collect() == []


def plain_best_fit(lengths, capacity):
    """Number of bins of best-fit decreasing, one piece after another."""
    room = []
    for length in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= length]
        if fits:
            room.remove(min(fits))
        insort(room, (min(fits) if fits else capacity) - length)
    return len(room)


@pytest.mark.parametrize("seed", range(25))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 37, 100])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 300))]
    if seed % 3 == 0:
        lengths = [rng.choice([1, 3, capacity // 2, capacity]) for _ in lengths]
    counts = {n: lengths.count(n) for n in set(lengths)}
    bins = {}
    for length, low, high, first, each, offset in packing.best_fit_decreasing(counts, capacity):
        for rank in range(low, high):
            nth = rank - low
            bins.setdefault(first + nth // each, []).append((offset + nth % each * length, length, (length, rank)))
    placed = sorted(x[2] for b in bins.values() for x in b)
    assert placed == sorted((n, r) for n, c in counts.items() for r in range(c))
    for b in bins.values():
        at = 0
        for offset, length, _ in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) == plain_best_fit(lengths, capacity)


def test_tightest_room():
    rng = random.Random(5)
    tree, rooms = packing.Room(50), set()
    for _ in range(2000):
        room = rng.randint(0, 50)
        (rooms.discard if room in rooms else rooms.add)(room)
        tree.set(room, room in rooms)
        length = rng.randint(0, 50)
        assert tree.tightest(length) == min((r for r in rooms if r >= length), default=None)


def test_sequences_give_the_tokens_back(spark):
    docs = odd_rows.frame(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    pieces = packing.materialize(packing.token_pieces(docs, JSON, 256), "pieces")
    placed = packing.place(pieces, 256)
    whole = {r.sequence_id: r.ids for r in packing.sequences(placed).collect()}
    for r in placed.collect():
        assert bytes(whole[r.sequence_id][4 * r.offset :][: 4 * r.length]) == bytes(r.ids)


def test_lengths_beyond_the_capacity_are_refused(spark):
    with pytest.raises(ValueError):
        packing.place(spark.createDataFrame([(1, 9)], "id long, length long"), 8)


def targets_by_rounds(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    capped, budget = set(), 1.5 * sum(sizes.values())
    while True:
        rest = budget - sum(2.0 * sizes[s] for s in capped)
        over = sum(weight[s] for s in names if s not in capped)
        target = {s: 2.0 * sizes[s] if s in capped else rest * weight[s] / over for s in names}
        more = {s for s in names if s not in capped and target[s] >= 2.0 * sizes[s]}
        if not more:
            return target
        capped |= more


def test_taken_words(spark):
    sized = odd_rows.frame(spark).withColumn("size", common.word_count(common.plain_text()))
    found = mixing.taken_words(sized, block=16).collect()
    assert len(found) == len(odd_rows.rows())
    sizes, taken = {}, {}
    for r in found:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = targets_by_rounds(sizes)
    for r in found:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
    for source, target in want.items():
        assert target - 48 <= taken[source] <= target
    again = mixing.taken_words(sized.repartition(7), block=16).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, found), key=repr)
    nothing = odd_rows.empty(spark).withColumn("size", F.lit(0).cast("long"))
    assert mixing.taken_words(nothing).collect() == []


def test_schedule_spreads_sources_evenly(spark):
    targets = spark.createDataFrame([("sa", 100, 50000.0), ("sb", 100, 30000.0), ("sc", 100, 20000.0)], "source string, source_size long, target double")
    slots = sorted(map(tuple, mixing.schedule(targets, 10).collect()))
    assert [s for s, _, _ in slots] == list(range(len(slots)))
    seen = {}
    for slot, source, rank in slots:
        assert rank == seen.get(source, 0)
        seen[source] = rank + 1
        for name, share in (("sa", 0.5), ("sb", 0.3), ("sc", 0.2)):
            assert abs(seen.get(name, 0) - share * (slot + 1)) < 4


def test_slots_hold_the_words_that_documents_give(spark):
    rows = [(i, "s" + "ab"[i % 2], i * 7 % 40) for i in range(60)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, size long")
    mixed = mixing.mixture(sizes, mixing.source_targets(sizes), block=16).collect()
    by_slot, by_pass = {}, {}
    for r in mixed:
        by_slot[r.slot] = by_slot.get(r.slot, 0) + r.words
        by_pass.setdefault((r.doc_id, r["pass"]), []).append((r.from_word, r.words))
    assert max(by_slot.values()) <= 16
    for (doc, _), parts in by_pass.items():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= rows[doc][2]


def test_small_sources_beside_a_hot_one_reach_their_targets(spark):
    rows = [(i, "hot", 1000) for i in range(2000)] + [(10_000 + i, f"s{i:03}", 20 + i) for i in range(200)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long")
    taken, target = {}, {}
    for r in mixing.taken_words(sized, block=128).collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert min(target.values()) < 128 and taken == {s: int(t) for s, t in target.items()}


def test_a_source_under_one_block_has_a_slot(spark):
    targets = spark.createDataFrame([("sa", 10**7, 2.0e7), ("sb", 30, 60.0), ("sc", 0, 0.0)], "source string, source_size long, target double")
    slots = mixing.schedule(targets, 128).groupBy("source").count().collect()
    count = {r.source: r["count"] for r in slots}
    assert set(count) == {"sa", "sb"} and count["sa"] >= 156_250


def test_places_in_the_mix_are_those_of_the_schedule(spark):
    rows = [(i, f"s{i % 4}" if i % 3 else "hot", i % 90) for i in range(300)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long")
    found = mixing.taken_words(sized, block=32).collect()
    keyed = sized.withColumn("source", mixing.source_key("source"))
    mixed = mixing.mixture(keyed, mixing.source_targets(keyed), 32).collect()
    slots = {}
    for r in mixed:
        slots.setdefault(r.doc_id, []).append(r.slot)
    for r in found:
        mine = slots.get(r.doc_id, [])
        assert (r.first_slot, r.n_pieces) == (min(mine, default=None), len(mine))
        assert (r.taken > 0) == (r.n_pieces > 0)
    # in the first tenth of the slots each source has near a tenth of its blocks, which a plain list of blocks has not
    line = mixing.schedule(mixing.source_targets(keyed), 32).collect()
    cut = len(line) // 10
    for source in {r.source for r in line}:
        ranks = [r.rank for r in line if r.source == source]
        early = sum(r.slot < cut for r in line if r.source == source)
        assert abs(early - len(ranks) / 10) <= 2
