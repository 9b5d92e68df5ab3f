"""Blocked products, intervals, batches, the table function and the packed data source."""

import glob
import os
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from siftmark.functions.table_functions import register_chunks
from siftmark.operators import matching
from siftmark.operators.batches import length_grouped_batches, padding_share
from siftmark.operators.intervals import first_interval
from siftmark.sources.packed_source import register_packed


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(c, i, rng.normal(size=20).tolist()) for c in (0, 1) for i in range(60)]
    validation = spark.createDataFrame([r for r in rows if r[1] < 12], "ckpt int, position long, vector array<double>")
    train = spark.createDataFrame([r for r in rows if r[1] >= 12], "ckpt int, train_id long, vector array<double>")
    return train, validation


def scores(df):
    return {r.train_id: r.score and round(r.score, 9) for r in df.collect()}


@pytest.mark.parametrize("blocks", [(4096, 256, 2048), (5, 2, 7), (1, 1, 1), (7, 3, 20)])
def test_blocks_of_any_size_give_the_plain_scores(vectors, blocks):
    train, validation = vectors
    weights = {0: 1.0, 1: 3.0}
    assert scores(matching.match_blocked(train, validation, 4, weights, *blocks)) == scores(
        matching.match_influence(train, validation, 4, weights)
    )


def test_large_centres_go_by_blocks(vectors, monkeypatch):
    train, validation = vectors
    want = scores(matching.match_influence(train, validation, 3))
    monkeypatch.setattr(matching, "MAX_CENTRE_VALUES", 10)
    assert scores(matching.match_influence(train, validation, 3)) == want


def test_blocked_rows_without_a_checkpoint_and_bad_vectors(spark, vectors):
    train, validation = vectors
    some = train.where("ckpt = 0 OR train_id % 2 = 0")
    found = scores(matching.match_blocked(some, validation, 4, None, 5, 2, 7))
    assert all((s is None) == bool(i % 2) for i, s in found.items()) and len(found) == 48
    short = train.withColumn("vector", F.when(F.col("train_id") != 20, F.col("vector")))
    with pytest.raises(PySparkException):
        matching.match_blocked(short, validation, 4).collect()
    assert matching.match_blocked(train.where("false"), validation, 4).collect() == []


@pytest.mark.parametrize("levels", [1, 4, 16])
def test_first_of_many_overlapping_intervals(spark, levels):
    rng = random.Random(4)
    kinds = [lambda: rng.uniform(0, 100), lambda: float(rng.randrange(100))]
    rows = []
    for n in range(10_000 if levels == 16 else 400):
        low = rng.choice(kinds)()
        rows.append((low, low + rng.choice([0.0, 0.001, 1.0, 30.0, 100.0, -5.0]), n))
    rng.shuffle(rows)
    rows += [(None, 5.0, -3), (5.0, None, -2), (float("nan"), 9.0, -1)]
    values = [rng.choice(kinds)() * 2.2 - 10 for _ in range(300)] + [None, float("nan"), float("inf"), 0.0]
    points = spark.createDataFrame(list(enumerate(values)), "id long, x double")
    table = spark.createDataFrame(rows, "low double, high double, nth long")
    got = {r.id: r.nth for r in first_interval(points, table, "id", "x", "nth", levels).collect()}
    good = sorted((n, a, b) for a, b, n in rows if None not in (a, b) and a < b)
    want = {k: next((n for n, a, b in good if x is not None and a <= x < b), None) for k, x in enumerate(values)}
    assert got == want
    nothing = first_interval(points, table.where("false"), "id", "x", "nth", levels).collect()
    assert len(nothing) == len(values) and all(r.nth is None for r in nothing)


def test_infinite_bounds_and_equal_intervals(spark):
    inf = float("inf")
    table = spark.createDataFrame([(-inf, 0.0, 5), (-inf, 0.0, 4), (3.0, inf, 1), (-inf, inf, 9)], "low double, high double, nth long")
    points = spark.createDataFrame([(1, -7.0), (2, 1.0), (3, 3.0), (4, 1e200), (5, -inf)], "id long, x double")
    found = first_interval(points, table, "id", "x", "nth")
    assert {r.id: r.nth for r in found.collect()} == {1: 4, 2: 9, 3: 1, 4: 1, 5: 4}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("label", [None, "kind"])
def test_batches_hold_every_row_once(spark, label):
    rng = random.Random(9)
    rows = [(i, rng.choice([None, 3, rng.randrange(500)]), rng.choice(["a", "a", "a", "b", None])) for i in range(1003)]
    table = spark.createDataFrame(rows, "id long, n int, kind string")
    found = length_grouped_batches(table, "id", "n", 10, 3, label).collect()
    assert sorted(r.id for r in found) == list(range(1003))
    groups = {}
    for r in found:
        groups.setdefault(r.batch, []).append(r)
    assert sorted(groups) == list(range(len(groups)))
    kinds = len({r[2] for r in rows}) if label else 1
    assert sum(len(g) < 10 for g in groups.values()) <= kinds
    for g in groups.values():
        assert sorted(r.place for r in g) == list(range(len(g)))
        assert {r.padded for r in g} == {max(r.n for r in g)}
        assert label is None or len({r.kind for r in g}) == 1
    lengths = [max(r.n for r in groups[b]) for b in sorted(groups)]
    assert lengths != sorted(lengths)  # batches come in drawn order
    share = padding_share(spark.createDataFrame(found), "n").first()
    assert share.padding < 0.1
    again = length_grouped_batches(table.repartition(7), "id", "n", 10, 3, label).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))
    assert length_grouped_batches(table.where("false"), "id", "n", 10, 3, label).collect() == []


def test_table_function_states_what_is_wrong(spark):
    register_chunks(spark)
    spark.sql("SELECT 1 AS id, array(1, 2, 3, 4, 5) AS ids UNION ALL SELECT 2, NULL UNION ALL SELECT 3, array()").createOrReplaceTempView("id_lists")
    rows = spark.sql("SELECT * FROM overlap_chunks(TABLE(id_lists), 'ids', 4)").collect()
    assert [tuple(r) for r in rows] == [(1, 0, 0, [1, 2, 3, 4]), (1, 1, 3, [4, 5])]
    for call in ("TABLE(id_lists), 'id', 4", "TABLE(id_lists), 'none', 4", "TABLE(id_lists), 'ids', 3", "1, 'ids', 4"):
        with pytest.raises(PySparkException):
            spark.sql(f"SELECT * FROM overlap_chunks({call})").collect()


@pytest.fixture()
def chunks(spark):
    register_packed(spark)
    return spark.range(40).select(F.col("id").alias("chunk_id"), F.sequence(F.lit(1), F.col("id") + 5).alias("tokens"))


@pytest.mark.parametrize("block", [1, 7, 10_000])
def test_packed_blocks_put_together_are_the_chunks(spark, chunks, tmp_path, block):
    path = f"{tmp_path}/set"
    chunks.repartition(5).write.format("packed").option("vocabulary", 100_000).mode("overwrite").save(path)
    assert len(glob.glob(f"{path}/train_*.bin")) == 40
    found = {}
    for r in spark.read.format("packed").option("blockSize", block).load(path).collect():
        found.setdefault(r.chunk_id, {})[r.block_no] = r.tokens
    whole = {c: [t for b in sorted(parts) for t in parts[b]] for c, parts in found.items()}
    assert whole == {r.chunk_id: r.tokens for r in chunks.collect()}


def test_a_failed_writer_leaves_nothing(spark, chunks, tmp_path):
    path = f"{tmp_path}/set"
    broken = chunks.repartition(4).withColumn(
        "chunk_id", F.when(F.col("chunk_id") == 33, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("chunk_id"))
    )
    with pytest.raises(PySparkException):
        broken.write.format("packed").mode("overwrite").save(path)
    assert os.listdir(tmp_path) == []
    twice = chunks.unionByName(chunks)
    with pytest.raises(PySparkException):
        twice.write.format("packed").mode("overwrite").save(path)
    assert os.listdir(tmp_path) == []
    chunks.write.format("packed").mode("overwrite").save(path)
    with pytest.raises(PySparkException):  # an earlier set stays as it was
        broken.write.format("packed").mode("overwrite").save(path)
    assert os.listdir(tmp_path) == ["set"] and spark.read.format("packed").load(path).count() == 40
    chunks.limit(3).write.format("packed").mode("overwrite").save(path)
    assert spark.read.format("packed").load(path).count() == 3


def test_a_short_file_is_refused(spark, chunks, tmp_path):
    path = f"{tmp_path}/set"
    chunks.write.format("packed").mode("overwrite").save(path)
    name = sorted(glob.glob(f"{path}/train_*.bin"))[7]
    with open(name, "r+b") as file:
        file.truncate(30)
    with pytest.raises(PySparkException):
        spark.read.format("packed").load(path).collect()
