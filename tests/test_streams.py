"""Losses folded as stream state: any order, any batches, lines that come again."""

import math
import random

import pytest

from siftmark.operators.weights import AgentWeights, fold_losses
from siftmark.streaming.folded_losses import folded_weights, follow_losses, merge_runs

SCHEMA = "family string, key string, line_no long, influence array<double>"


def folded(values):
    weight = 0.0
    for loss in values:
        weight = 0.9 * weight + 0.1 * math.exp(0.5 * loss)
    return weight


@pytest.mark.parametrize("seed", range(5))
def test_runs_of_any_order_fold_to_the_whole(seed):
    draw = random.Random(seed)
    losses = [[draw.uniform(-1, 3) for _ in range(draw.randint(0, 3))] for _ in range(60)]
    lines = [(i, i, len(v), folded(v), v[-1] if v else 0.0) for i, v in enumerate(losses)]
    arriving = lines + draw.choices(lines, k=30)
    draw.shuffle(arriving)
    runs = []
    while arriving:
        cut = draw.randint(1, 9)
        runs = merge_runs(runs, arriving[:cut], 0.9)
        arriving = arriving[cut:]
        assert all(a[1] + 1 < b[0] for a, b in zip(runs, runs[1:]))
    everything = [x for v in losses for x in v]
    assert [r[:3] for r in runs] == [(0, 59, len(everything))]
    assert runs[0][3] == pytest.approx(folded(everything)) and runs[0][4] == everything[-1]
    assert merge_runs(runs, lines, 0.9) == runs


def test_a_stream_stopped_and_run_again_equals_one_batch(spark, tmp_path):
    draw = random.Random(3)
    rows = [("domain", "c4" if i % 3 else "arxiv", i, [draw.uniform(-1, 3) for _ in range(i % 4)]) for i in range(200)]
    rows += [("topic", "topic_1", 5, None), ("topic", "topic_99", 6, [1.0]), ("topic", None, 1, [1.0])]
    lines = spark.createDataFrame(rows, SCHEMA)
    arrived, output, checkpoint = (f"{tmp_path}/{n}" for n in ("lines", "folded", "checkpoint"))
    setting = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for part in ("line_no >= 150", "line_no < 100", "line_no BETWEEN 90 AND 160"):
        lines.where(part).coalesce(1).write.mode("append").parquet(arrived)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(arrived)
        follow_losses(stream, output, checkpoint, block_bits=4).awaitTermination()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == setting
    want = {(r.family, r.key): r for r in fold_losses(lines, AgentWeights()).collect()}
    got = folded_weights(spark, output, AgentWeights()).collect()
    assert len(got) == len(want)
    for r in got:
        other = want[r.family, r.key]
        assert (r.n, r.last_loss) == (other.n, other.last_loss) and r.weight == pytest.approx(other.weight)
    # the blocks of c4, whose every third number is another category's, are runs of at most two lines
    runs = [run for r in spark.read.parquet(output).where("key = 'c4'").collect() for run in r.runs]
    assert max(run["last"] - run["first"] for run in runs) == 1
