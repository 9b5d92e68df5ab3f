"""Category weights as keyed stream state.

A line's losses fold from zero to (n, gained, last_loss), and lines next to each
other fold to the same three numbers. The state of a block of a category's lines
is its runs: stretches of line numbers without a gap, each folded to one entry.
So the state does not depend on the order in which lines arrive, a line that
comes again lies inside a run and changes nothing, and a gap that closes joins
two runs to one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from siftmark.operators.weights import AgentWeights, UpdateRule, fold_blocks, line_fold

RUNS = "runs array<struct<first: bigint, last: bigint, n: bigint, gained: double, last_loss: double>>"
FOLDED = f"family string, key string, block bigint, version bigint, {RUNS}"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Run = tuple[int, int, int, float, float]


def merge_runs(runs: list[Run], lines: list[Run], keep: float) -> list[Run]:
    """``runs`` with ``lines`` put in, in order; lines that runs hold already are left out.

    ``keep`` is what one later loss leaves of a weight.
    """
    merged: list[Run] = []
    for run in sorted([*runs, *lines], key=lambda r: (r[0], -r[1])):
        if merged and run[0] <= merged[-1][1]:
            continue
        if merged and run[0] == merged[-1][1] + 1:
            first, _, n, gained, last_loss = merged.pop()
            loss = run[4] if run[2] else last_loss
            run = (first, run[1], n + run[2], keep ** run[2] * gained + run[3], loss)
        merged.append(run)
    return merged


class RunFolder(StatefulProcessor):
    """State (version, runs) of each (family, key, block); every change gives a row."""

    def __init__(self, keep: float):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("folded", f"version bigint, {RUNS}")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        version, runs = self.state.get() if self.state.exists() else (0, [])
        held = [tuple(r) for r in runs]
        found = list(held)
        for batch in rows:  # at most a block of lines in all, whatever repeats
            new = zip(*(batch[c].tolist() for c in ("line_no", "line_no", "n", "gained", "last_loss")))
            found = merge_runs(found, list(new), self.keep)
        if found == held:
            return
        self.state.update((version + 1, found))
        row = [*key, version + 1, [dict(zip(("first", "last", "n", "gained", "last_loss"), r)) for r in found]]
        yield pd.DataFrame([row], columns=["family", "key", "block", "version", "runs"])

    def close(self) -> None:
        pass


def follow_losses(
    lines: DataFrame, output: str, checkpoint: str, rule: UpdateRule = UpdateRule(), block_bits: int = 16
) -> StreamingQuery:
    """Fold the streamed (family, key, line_no, influence) rows that are there now; run again for more.

    Each line is folded where it is read; what is shuffled is one narrow row per
    line, by (category, block of 65,536 line numbers), so a category with most
    lines spreads over its blocks and a group's rows are bounded. Lines without
    losses count for their place only, so that they leave no gap; a null
    influence is such a line, and a line without a number is skipped. Changed
    blocks are appended under ``output``; the sink's log and the state's
    checkpoint make each batch count once. Line numbers are those of a category,
    each given to one line.
    """
    some = F.coalesce("influence", F.array().cast("array<double>"))
    narrow = lines.where("line_no IS NOT NULL").withColumn("influence", some).select(
        "family", "key", F.shiftright("line_no", block_bits).alias("block"), "line_no", *_of_any_size(rule)
    )
    folded = narrow.groupBy("family", "key", "block").transformWithStateInPandas(
        statefulProcessor=RunFolder(1 - rule.eta), outputStructType=FOLDED, outputMode="Append", timeMode="None"
    )
    sink = folded.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    sink = sink.outputMode("append").trigger(availableNow=True)
    conf, name = lines.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, STATE_STORE)  # the stream takes a copy of the settings when it starts
    try:
        return sink.start(output)
    finally:
        conf.set(name, before)


def _of_any_size(rule: UpdateRule) -> list:
    n, gained, _ = line_fold(rule)
    return [n, gained, F.coalesce(F.try_element_at("influence", F.lit(-1)), F.lit(0.0)).alias("last_loss")]


def folded_weights(
    spark: SparkSession, output: str, weights: AgentWeights, rule: UpdateRule = UpdateRule()
) -> DataFrame:
    """What ``fold_losses`` gives for all lines folded so far: the newest state of each block."""
    states = spark.read.schema(FOLDED).parquet(output)
    newest = states.groupBy("family", "key", "block").agg(F.max_by("runs", "version").alias("runs"))
    start = weights.to_frame(spark)
    parts = newest.join(F.broadcast(start.select("family", "key", "ord")), ["family", "key"])  # a row per category
    parts = parts.select("ord", "block", F.explode("runs").alias("run")).where("run.n > 0")
    columns = "ord", "block", F.col("run.first").alias("line_no"), "run.n", "run.gained", "run.last_loss"
    return fold_blocks(start, parts.select(*columns), rule)
