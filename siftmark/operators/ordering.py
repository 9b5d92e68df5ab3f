"""Positions and running totals that never put a whole group in one task.

A plain ``row_number() over (partition by key order by ...)`` sorts each key in
a single task, and an unpartitioned window sorts everything in one. Both
operators here split the ordered rows into bounded stretches, total the
stretches, and add the totals of the earlier ones back to each row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmark.session import materialize


def _before(total: str, partition: Sequence[str], order: str) -> Column:
    frame = (
        Window.partitionBy(*partition)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return F.coalesce(F.sum(total).over(frame), F.lit(0).cast("long"))


def running_total(
    df: DataFrame,
    id_col: str,
    size: Column | None = None,
    groups: Sequence[str] = (),
    out: str = "position",
    bits: int = 16,
    upper: int = 24,
) -> DataFrame:
    """Add ``out``: the total ``size`` of rows with a smaller ``id_col`` in the group.

    ``id_col`` is a long, unique within its group; neither it nor the groups
    may be null. Only what is in ``df`` is sorted along, so pass narrow rows.
    With no ``size`` every row counts one, so ``out`` is the zero-based position. Ids are cut into digits:
    the lowest ``bits`` bits order rows in a block, the next ``upper`` bits
    order blocks, the rest order stretches of blocks. As ids are unique, the
    windows hold at most 65,536 rows or 16.8 million block totals, however the
    ids are spread and however large one group is.
    """
    groups = list(groups)
    size = F.lit(1).cast("long") if size is None else size.cast("long")
    # never null, so that both uses of the block totals plan alike and share one scan
    block = F.coalesce(F.shiftright(id_col, bits), F.lit(0).cast("long"))
    rows = df.withColumn("_size", size).withColumn("_b0", block)

    blocks = rows.groupBy(*groups, "_b0").agg(F.sum("_size").alias("_t0"))
    blocks = blocks.withColumn("_b1", F.shiftright("_b0", upper))
    stretches = blocks.groupBy(*groups, "_b1").agg(F.sum("_t0").alias("_t1"))

    stretch_start = stretches.select(*groups, "_b1", _before("_t1", groups, "_b1").alias("_s1"))
    block_start = blocks.join(stretch_start, [*groups, "_b1"]).select(
        *groups, "_b0", (F.col("_s1") + _before("_t0", [*groups, "_b1"], "_b0")).alias("_s0")
    )
    inside = rows.withColumn("_in", _before("_size", [*groups, "_b0"], id_col))
    return inside.join(block_start, [*groups, "_b0"]).select(
        *[F.col(c) for c in df.columns], (F.col("_s0") + F.col("_in")).alias(out)
    )


def sorted_positions(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[Column],
    out: str = "position",
    count: str | None = None,
) -> DataFrame:
    """Add the zero-based position within ``groups`` under any total ``order``.

    Rows are range-partitioned on (groups, order), so a hot group spans many
    partitions, and numbered inside each partition. The numbered table is
    written to the shared folder before its stretches are totalled: both
    readers then see the same partition bounds, also after an executor loss.
    ``order`` should end in a unique column; groups may not be null. ``count`` names an optional
    column for the group's row count.
    """
    groups = list(groups)
    keys = [*[F.col(g) for g in groups], *order]
    numbered = materialize(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33)),
        "positions",
    )
    stretches = numbered.groupBy(*groups, "_part").agg(
        F.count("*").alias("_n"), F.min("_at").alias("_first")
    )
    starts = stretches.select(
        *groups,
        "_part",
        (_before("_n", groups, "_part") - F.col("_first")).alias("_shift"),
        F.sum("_n").over(Window.partitionBy(*groups)).alias("_total"),
    )
    joined = numbered.join(starts, [*groups, "_part"])
    extra = [F.col("_total").alias(count)] if count else []
    return joined.select(
        *[F.col(c) for c in df.columns], (F.col("_at") + F.col("_shift")).alias(out), *extra
    )
