import math
import random
import time

import pytest
from pyspark.sql import functions as F

from siftmark.functions import vectors
from siftmark.operators import metrics

DRAW = random.Random(4)
ROWS = [(DRAW.choice([0, 0, 0, 1, 2, 5]), [DRAW.choice([0.1, 0.5, 0.9]) for _ in range(6)]) for _ in range(200)]


def frame(spark):
    return spark.createDataFrame(ROWS, "label int, logits array<double>")


def predicted():
    return [(y, max(range(6), key=lambda c: (z[c], -c))) for y, z in ROWS]


def scores(pairs):
    out = {}
    for c in sorted({y for y, _ in pairs} | {p for _, p in pairs}):
        hit = sum(y == p == c for y, p in pairs)
        guess, have = sum(p == c for _, p in pairs), sum(y == c for y, _ in pairs)
        precision = hit / guess if guess else 0.0
        recall = hit / have if have else 0.0
        f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
        out[c] = (precision, recall, f1, have)
    return out


def test_report_macro_and_threshold_counts(spark):
    pairs = predicted()
    cells = metrics.confusion(metrics.with_predictions(frame(spark)))
    expected = scores(pairs)
    accuracy = sum(y == p for y, p in pairs) / len(pairs)
    report = metrics.class_report(cells).orderBy("place").collect()
    order = sorted(expected, key=lambda c: (-expected[c][3], c))
    assert [r.name for r in report] == [*map(str, order), "accuracy", "macro avg", "weighted avg"]
    for row, c in zip(report, order):
        assert (row.precision, row.recall, row.f1, row.support) == pytest.approx(expected[c])
    assert (report[-3].precision, report[-3].support) == pytest.approx((accuracy, accuracy))
    macro = [sum(v[i] for v in expected.values()) / len(expected) for i in range(3)]
    assert (report[-2].precision, report[-2].recall, report[-2].f1) == pytest.approx(macro)
    weighted = [sum(v[i] * v[3] for v in expected.values()) / len(pairs) for i in range(3)]
    assert (report[-1].precision, report[-1].recall, report[-1].f1) == pytest.approx(weighted)

    row = metrics.macro_metrics(cells).first()
    assert (row.precision, row.recall, row.f1, row.accuracy) == pytest.approx([*macro, accuracy])
    counts = {r.threshold: r.rows for r in metrics.precision_counts(metrics.class_report(cells)).collect()}
    for limit, n in counts.items():
        assert n == sum(r.precision > limit for r in report)


def test_top_k_breaks_ties_towards_the_higher_class(spark):
    got = {r.k: r.accuracy for r in metrics.top_k_accuracy(frame(spark)).collect()}
    for k in range(1, 6):
        hits = sum(y in sorted(range(6), key=lambda c: (z[c], c), reverse=True)[:k] for y, z in ROWS)
        assert got[k] == pytest.approx(hits / len(ROWS))


def test_label_map_is_global_and_sorted(spark):
    topics = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("c",)], "t string").repartition(4)
    assert {r.topic: r.label for r in metrics.label_map(topics, "t").collect()} == {"a": 0, "b": 1, "c": 2}


def test_softmax_loss_and_sampling(spark):
    rows = [([1.0, 2.0, 3.0, 2.0], 2), ([1000.0, 999.0, 0.0, 0.0], 1), ([0.0, 0.0, 0.0, 0.0], -1)]
    z = F.col("z")
    got = spark.createDataFrame(rows, "z array<double>, y int").select(
        vectors.softmax(z).alias("p"),
        vectors.cross_entropy(z, F.col("y")).alias("loss"),
        vectors.softmax_kept(vectors.crop_to_top(z, 2), 0.5).alias("top"),
        vectors.argmax(z).alias("best"),
    ).collect()
    for (logits, y), r in zip(rows, got):
        e = [math.exp(v - max(logits)) for v in logits]
        assert r.p == pytest.approx([v / sum(e) for v in e])
        if y < 0:
            assert r.loss is None
        else:
            assert r.loss == pytest.approx(-(logits[y] - max(logits)) + math.log(sum(e)))
        assert r.best == logits.index(max(logits))
        assert sum(v > 0 for v in r.top) <= 2 and sum(r.top) == pytest.approx(1)
    assert got[0].top == pytest.approx([0, 1 / (1 + math.exp(2)), 1 / (1 + math.exp(-2)), 0])
    draws = spark.range(1).select(
        *[vectors.draw_from(F.array(F.lit(0.2), F.lit(0.0), F.lit(0.8)), F.lit(u)).alias(f"u{i}")
          for i, u in enumerate([0.0, 0.19, 0.2, 0.99, 1.0])]
    ).first()
    assert list(draws) == [0, 0, 2, 2, 2]


def test_wide_logits_are_sorted_once_a_row(spark):
    wide, rows = 6000, 4
    logits = F.transform(F.sequence(F.lit(0), F.lit(wide - 1)), lambda i: ((i * 7919 + F.col("id")) % wide).cast("double"))
    kept = vectors.softmax_kept(vectors.crop_to_top(logits, 3), 0.8)
    began = time.monotonic()
    got = spark.range(rows, numPartitions=2).select("id", vectors.draw_from(kept, F.lit(0.5)).alias("next")).collect()
    assert time.monotonic() - began < 20  # a sort for each element takes minutes
    for r in got:
        top = sorted(range(wide), key=lambda i: -((i * 7919 + r.id) % wide))[:3]
        e = {i: math.exp(((i * 7919 + r.id) % wide - wide) / 0.8) for i in sorted(top)}
        upto = [sum(v for j, v in e.items() if j <= i) / sum(e.values()) for i in e]
        assert r.next == next(i for i, u in zip(e, upto) if u > 0.5)


def test_token_weighted_loss(spark):
    row = metrics.token_weighted_loss(
        spark.createDataFrame([(2.0, 10), (4.0, 30)], "loss double, num_tokens long")
    ).first()
    assert (row.num_tokens, row.loss) == (40, 3.5)
