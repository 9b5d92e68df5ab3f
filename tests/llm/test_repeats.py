"""Removal of repeated windows next to counting every window."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import odd_rows
from siftmark.llm import repeats, substring_tree, suffix_parse
from siftmark.session import materialize


def gone_by_counting(sequences, width):
    """For each sequence which places lie in a window that starts twice or more."""
    count = Counter(s[i : i + width] for s in sequences for i in range(len(s) - width + 1))
    out = []
    for s in sequences:
        gone = [False] * len(s)
        for i in range(len(s) - width + 1):
            if count[s[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        out.append(gone)
    return out


def texts():
    rng = random.Random(7)
    stock = [" ".join(odd_rows.words(i, rng.randrange(20, 90), 300)) for i in range(12)]
    made = [" ".join(rng.choice(stock) if rng.random() < 0.7 else f"u{rng.random()}" for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    return made + ["la " * 300, "é" * 700, "ab" * 400, "x"] + made[:2]


@pytest.fixture(params=[500, 1], ids=["trees", "split"])
def large(request):
    return request.param


def table(spark, odd):
    if odd:
        return odd_rows.frame(spark), [r[:2] for r in odd_rows.rows()]
    rows = list(enumerate(texts()))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows


@pytest.mark.parametrize("odd", [False, True])
def test_words(spark, large, odd):
    docs, rows = table(spark, odd)
    sequences = [tuple((t or "").encode().split()) for _, t in rows]
    want = []
    for (i, _), s, gone in zip(rows, sequences, gone_by_counting(sequences, 35)):
        kept = b" ".join(w for w, g in zip(s, gone) if not g)
        want.append((i, len(s), sum(gone), kept.decode(), hashlib.sha256(kept).hexdigest()))
    found = map(tuple, substring_tree.without_repeats(docs, large=large).collect())
    assert sorted(found, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("odd", [False, True])
def test_bytes(spark, large, odd):
    docs, rows = table(spark, odd)
    sequences = [(t or "").encode() for _, t in rows]
    want = []
    for (i, _), s, gone in zip(rows, sequences, gone_by_counting(sequences, 200)):
        kept = bytes(b for b, g in zip(s, gone) if not g)
        spans = sum(1 for a, b in zip([False, *gone], gone) if b and not a)
        want.append((i, len(s), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    found = [tuple(r) for r in suffix_parse.without_repeats(docs, large=large).drop("kept").collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("engine", [substring_tree, suffix_parse])
def test_windows_of_large_triggers_are_counted_together(spark, monkeypatch, engine):
    """Neither a row for each phrase and share, nor a search among all windows of a share."""
    files = {}

    def kept(df, label):
        made = materialize(df, label)
        files[label] = made.inputFiles()
        return made

    monkeypatch.setattr(repeats, "materialize", kept)
    engine.without_repeats(table(spark, False)[0], large=1).count()
    stored = {label: spark.read.parquet(*names) for label, names in files.items()}
    many = stored["phrases"].groupBy("trigger").count().where("count > 1")
    assert many.count() > 0
    together = stored["phrase-texts"].where("phrases IS NOT NULL").selectExpr("explode(phrases) AS phrase")
    assert together.count() == many.agg({"count": "sum"}).first()[0]
    counted = repeats._counted(stored["phrase-texts"])
    assert counted.count() > 0
    assert "array_intersect" not in counted._jdf.queryExecution().optimizedPlan().toString()


def test_empty_tables(spark):
    assert substring_tree.without_repeats(odd_rows.empty(spark)).collect() == []
    assert suffix_parse.without_repeats(odd_rows.empty(spark)).collect() == []


def test_runs_cover_each_window_once_whatever_the_slab():
    rng = np.random.default_rng(3)
    symbols = rng.integers(1, 50, 3000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    runs = repeats.Runs(35, 10)
    lengths = np.array([34, 35, 0, 1000, 1931])
    trigger, phrase, part, place = runs.find(repeats.Rolling(), symbols, lengths)
    begin, more = np.divmod(place, runs.grams)
    windows = sorted((p, b + k) for p, b, m in zip(part, begin, more) for k in range(m + 1))
    assert windows == [(p, i) for p, n in enumerate(lengths) for i in range(max(0, n - 34))]
    alone = runs.find(repeats.Rolling(), symbols[69:1069], np.array([1000]))
    assert (alone[0] == trigger[part == 3]).all() and (alone[1] == phrase[part == 3]).all()


@pytest.mark.parametrize("width,first", [(35, 1), (200, 4), (7, 1)])
def test_deepest_nodes(width, first):
    rng = random.Random(width)
    block = [rng.randrange(1, 4) for _ in range(width * 3)]
    codes = np.array(block + [0] + [rng.randrange(1, 4) for _ in range(width)] + block[5:-3] + [0], np.int64)
    starts = np.arange(len(codes) - width + 1)
    names = suffix_parse.ranks_of_four(codes) if first == 4 else codes
    count = Counter(tuple(codes[i : i + width]) for i in starts)
    want = [count[tuple(codes[i : i + width])] > 1 for i in starts]
    assert repeats.deepest(names, first, width, starts).tolist() == want
