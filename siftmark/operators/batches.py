"""Batches of rows of like length, so that little of a batch is padding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.functions.chance import uniform
from siftmark.operators.ordering import sorted_positions


def length_grouped_batches(
    rows: DataFrame, id_col: str, length: str, size: int, seed: int = 0, label: str | None = None
) -> DataFrame:
    """(id, length, [label,] batch, place, padded): every row in one batch of ``size`` rows.

    Rows are cut into batches in order of length, equal lengths by a draw from the
    seed and the id; only the last batch may be smaller. ``place`` is the row's place
    in its batch and ``padded`` the greatest length there. Batches are numbered
    from 0 in an order drawn from the seed. With ``label``, a batch holds rows of one
    label only, and each label may have one smaller batch; a null label is a label.

    Ids are unique and not null. A null length counts as 0. An empty table gives
    none. Rows are ranked in ranges of (label, length), so neither a common length nor
    a label that most rows have fills one task.
    """
    if size < 1:
        raise ValueError("a batch has at least one row")
    kept = rows.select(
        id_col,
        F.coalesce(F.col(length), F.lit(0)).cast("long").alias(length),
        F.struct(F.col(label) if label else F.lit(0)).alias("_label"),
    )
    order = [F.col(length), uniform(seed, F.col(id_col)), F.col(id_col)]
    ranked = sorted_positions(kept, ["_label"], order, "_rank")
    ranked = ranked.withColumn("_nth", F.floor(F.col("_rank") / size)).withColumn("place", F.col("_rank") % size)
    batches = ranked.groupBy("_label", "_nth").agg(F.max(length).alias("padded"), F.min(id_col).alias("_least"))
    # batches are told apart by their least id
    drawn = [uniform(seed, F.lit("batch"), F.col("_least")), F.col("_least")]
    numbered = sorted_positions(batches, [], drawn, "batch").drop("_least")
    found = ranked.join(numbered, ["_label", "_nth"])
    named = [F.col("_label")[label].alias(label)] if label else []
    return found.select(id_col, length, *named, "batch", "place", "padded")


def padding_share(batches: DataFrame, length: str) -> DataFrame:
    """(rows, tokens, padded, padding): over all batches, and the share of padding in them."""
    sums = batches.agg(
        F.count("*").alias("rows"), F.sum(length).alias("tokens"), F.sum("padded").alias("padded")
    )
    return sums.withColumn("padding", F.when(F.col("padded") > 0, 1 - F.col("tokens") / F.col("padded")))
