import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftmark.functions import vectors
from siftmark.operators import matching
from siftmark.operators.influence import first_step_loss
from siftmark.operators.projection import ROW_BLOCK, random_projection, sign_block
from siftmark.operators.providers import TokenShares, apply_provider

SCHEMA = "ckpt int, id long, vector array<float>"


def blocks(rows, width, seed, ckpts=(0, 1)):
    draw = np.random.default_rng(seed)
    return {c: draw.normal(size=(rows, width)).astype(np.float32) for c in ckpts}


def frame(spark, data, name):
    rows = [(c, i, v.tolist()) for c, m in data.items() for i, v in enumerate(m)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).withColumnRenamed("id", name)


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("subtasks", [1, 9])
def test_matching_equals_all_pairs(spark, wide, subtasks):
    train, validation = blocks(40, 12, 1), blocks(18, 12, 2)
    shares = {0: 1.0, 1: 3.0}
    total = sum(w / 4 * train[c].astype(float) @ validation[c].astype(float).T for c, w in shares.items())
    expected = total.reshape(40, subtasks, -1).mean(-1).max(-1)
    got = matching.match_influence(
        frame(spark, train, "train_id"),
        frame(spark, validation, "position"),
        subtasks,
        shares,
        wide,
    ).orderBy("train_id").collect()
    assert [r.score for r in got] == pytest.approx(expected.tolist(), rel=1e-9)


def test_bad_matching_inputs(spark):
    train, validation = blocks(4, 3, 1), blocks(5, 3, 2)
    with pytest.raises(ValueError, match="subtasks"):
        matching.match_influence(frame(spark, train, "train_id"), frame(spark, validation, "position"), 2)
    with pytest.raises(ValueError, match="checkpoint"):
        matching.match_influence(
            frame(spark, train, "train_id"), frame(spark, validation, "position"), 1, {0: 1.0}
        )
    assert matching.renormalize([1.0, 3.0]) == [0.25, 0.75]
    assert matching.renormalize([0.5, 0.5]) == [0.5, 0.5]


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("bad", [None, [1.0, 2.0], [1.0, 2.0, 3.0, 4.0], [1.0, None, 2.0]])
def test_bad_vectors_stop_both_ways(spark, wide, bad):
    rows = [(0, 1, [1.0, 2.0, 3.0]), (0, 2, bad)]
    train = spark.createDataFrame(rows, "ckpt int, train_id long, vector array<float>")
    held = frame(spark, blocks(2, 3, 2, ckpts=(0,)), "position")
    with pytest.raises(Exception, match="null or has another width"):
        matching.match_influence(train, held, 1, wide=wide).collect()


@pytest.mark.parametrize("wide", [False, True])
def test_rows_without_every_checkpoint_are_marked(spark, wide):
    rows = [(0, 1, [1.0]), (1, 1, [1.0]), (0, 2, [1.0]), (0, 3, [1.0]), (0, 3, [1.0])]
    train = spark.createDataFrame(rows, "ckpt int, train_id long, vector array<float>")
    held = spark.createDataFrame([(0, 0, [2.0]), (1, 0, [4.0])], "ckpt int, position long, vector array<float>")
    got = matching.match_influence(train, held, 1, {0: 1.0, 1: 1.0}, wide)
    assert {r.train_id: r.score for r in got.collect()} == {1: 3.0, 2: None, 3: None}


def test_vector_expressions(spark):
    rows = [([3.0, -4.0], [0.1, 0.2], [0.01, 0.0]), ([0.0, 0.0], [0.0, 0.0], [0.0, 0.0])]
    g, m, v = F.col("g"), F.col("m"), F.col("v")
    got = spark.createDataFrame(rows, "g array<double>, m array<double>, v array<double>").select(
        vectors.l2_normalize(g).alias("n"),
        vectors.sign_gradient(g).alias("s"),
        vectors.adam_gradient(g, m, v).alias("a"),
        vectors.dot(g, m).alias("d"),
    ).collect()
    assert got[0].n == pytest.approx([0.6, -0.8]) and got[1].n == [0.0, 0.0]
    assert got[0].s == [1.0, -1.0] and got[0].d == pytest.approx(-0.5)
    g, m, v = (np.array(x) for x in rows[0])
    adam = (0.9 * m + 0.1 * g) / np.sqrt(0.999 * v + 0.001 * g * g + 1e-8)
    assert got[0].a == pytest.approx(adam.tolist())


def test_projection_is_seeded_and_keeps_products(spark):
    width, dim = ROW_BLOCK + 44, 2048
    data = blocks(6, width, 3, ckpts=(0,))
    source = frame(spark, data, "id")
    first = random_projection(source, "vector", dim, seed=5).orderBy("id").collect()
    again = random_projection(source.repartition(2), "vector", dim, seed=5).orderBy("id").collect()
    assert [r.vector for r in first] == [r.vector for r in again]
    signs = np.vstack([sign_block(5, 0, ROW_BLOCK, dim), sign_block(5, ROW_BLOCK, 44, dim)])
    assert set(np.unique(signs)) == {-1.0, 1.0} and abs(signs.mean()) < 0.01
    projected = np.array([r.vector for r in first])
    assert projected == pytest.approx(data[0].astype(float) @ signs)
    exact = data[0] @ data[0].T
    assert np.abs(projected @ projected.T / dim - exact).max() < 0.15 * exact.max()
    other = random_projection(source, "vector", dim, seed=6).orderBy("id").first()
    assert other.vector != first[0].vector


def test_first_step_and_shares_by_hand(spark):
    tokens = {1: [0, 0, 2], 2: [1], 3: [], 4: [0, 1, 2, 3], 5: None, 6: [3, 3, 3, 3, 0]}
    rows = spark.createDataFrame(list(tokens.items()), "id long, tokens array<int>").repartition(2)
    share = {i: np.bincount(np.array(t or [], dtype=int), minlength=4) / max(len(t or []), 1) for i, t in tokens.items()}
    some = rows.where("tokens IS NOT NULL")
    got = {r.id: r.g for r in apply_provider(some, "tokens", TokenShares(4), "g").collect()}
    assert got == {i: pytest.approx(s.tolist()) for i, s in share.items() if i != 5}

    held = np.array([0.25, 0.0, 0.75, 0.0])
    held_out = spark.createDataFrame([(0, 0.25), (2, 0.75)], "token int, share double")
    for clip in (1.0, 1e-7):
        losses = first_step_loss(rows, "id", "tokens", held_out, 4, clip=clip).collect()
        assert len(losses) == len(tokens)
        for r in losses:
            g = 0.25 - share[r.id]
            g = g * min(1.0, clip / max(np.linalg.norm(g), 1e-12))
            odds = -1e-3 * g / (np.abs(g) + 1e-8)
            assert r.influence == pytest.approx(-(held * (odds - np.log(np.exp(odds).sum()))).sum(), abs=1e-12)


def test_a_worker_opens_its_model_once(spark):
    class CountsOpens:
        """Counts in the worker's environment, which its tasks share."""

        def open(self):
            os.environ["OPENED"] = str(int(os.environ.get("OPENED", "0")) + 1)

        def rows(self, tokens):
            return [np.array([float(os.environ["OPENED"])]) for _ in tokens]

    rows = spark.range(40, numPartitions=20).selectExpr("id", "array(1) AS tokens")
    got = apply_provider(rows, "tokens", CountsOpens(), "g").collect()
    assert len(got) == 40 and {r.g[0] for r in got} == {1.0}
