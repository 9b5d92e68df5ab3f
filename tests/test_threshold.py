import random

import pytest

from siftmark.operators.threshold import flag_top_n, reaching, select_top_share, top_n_threshold


def spread(kind, size=300):
    draw = random.Random(kind)
    return {
        "uniform": [draw.random() for _ in range(size)],
        "ties": [draw.choice([0.1, 0.2, 0.2, 0.3]) for _ in range(size)],
        "one_value": [0.25] * size,
        "signs": [draw.gauss(0, 1) for _ in range(size)] + [0.0] * 20,
        "negative": [-draw.random() for _ in range(size)],
        "close": [1.0 + i * 2.0**-52 for i in range(size)],
        "scales": [10.0 ** draw.randint(-300, 300) for _ in range(size)],
        "infinite": [draw.choice([1.0, 2.0, float("inf"), float("-inf")]) for _ in range(size)],
        "tiny": [5e-324 * draw.randint(0, 9) for _ in range(size)],
    }[kind]


@pytest.mark.parametrize(
    "kind", ["uniform", "ties", "one_value", "signs", "negative", "close", "scales", "tiny", "infinite"]
)
def test_threshold_is_the_nth_largest(spark, kind):
    scores = spread(kind)
    frame = spark.createDataFrame([(s,) for s in scores], "s double").repartition(3).cache()
    for n in (1, 7, len(scores) // 2, len(scores), 10_000):
        assert top_n_threshold(frame, "s", n) == sorted(scores, reverse=True)[:n][-1]


def test_ties_are_kept_and_nulls_are_not(spark):
    rows = [(i, s) for i, s in enumerate([0.5, 0.5, 0.5, 0.1, None, float("nan")])]
    flagged = flag_top_n(spark.createDataFrame(rows, "id int, s double"), "s", 2).collect()
    assert {r.id: r.selection for r in flagged} == {0: 1, 1: 1, 2: 1, 3: 0, 4: 0, 5: 0}


def test_no_rows(spark):
    empty = spark.createDataFrame([], "s double")
    assert top_n_threshold(empty, "s", 3) is None
    assert flag_top_n(empty, "s", 3).count() == 0


def test_none_are_wanted(spark):
    frame = spark.range(5).selectExpr("cast(id as double) s")
    for n in (0, -3):
        assert top_n_threshold(frame, "s", n) is None
        assert flag_top_n(frame, "s", n).where("selection = 1").count() == 0


def test_nan_is_not_counted_in_a_share(spark):
    frame = spark.createDataFrame([(float(i),) for i in range(10)] + [(float("nan"),)] * 90 + [(None,)], "s double")
    assert [r.s for r in select_top_share(frame, "s", 10).collect()] == [9.0]


def test_top_share(spark):
    frame = spark.range(200).selectExpr("id", "cast(id as double) s")
    assert sorted(r.id for r in select_top_share(frame, "s", 1).collect()) == [198, 199]
    assert select_top_share(frame, "s", 0.1).count() == 0


def test_selection_is_pushed_into_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id / 100D AS score").write.parquet(f"{tmp_path}/s")
    stored = spark.read.parquet(f"{tmp_path}/s")
    best = reaching(stored, "score", top_n_threshold(stored, "score", 5))
    assert sorted(r.id for r in best.collect()) == list(range(95, 100))
    assert "GreaterThanOrEqual(score,0.95)" in best._jdf.queryExecution().executedPlan().toString()
    assert reaching(stored, "score", None).count() == 0
