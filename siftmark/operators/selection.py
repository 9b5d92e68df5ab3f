"""From selection flags back to the source lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.session import materialize

LINE_KEY = ("subfolder", "file", "line_no")
STRETCH = 32_768
STRETCH_BYTES = STRETCH // 8
PACKED_BYTES = 200_000_000


def is_selected(flag: Column) -> Column:
    """Whether a raw flag means 1: ``1``, ``1.0`` and ``true`` do, a missing one does not."""
    return F.coalesce(F.lower(flag.cast("string")).isin("1", "1.0", "true"), F.lit(False))


def lines_of(source: DataFrame, chosen: DataFrame) -> DataFrame:
    """Source lines with the (subfolder, file, line_no) of a chosen row.

    The source is far bigger than the keys, so it should not be shuffled for
    them: line numbers become bits, one map of 4,096 bytes for each stretch of
    32,768 lines, stored once and, up to ``PACKED_BYTES``, broadcast. Beyond that
    both sides are shuffled on the full key, which spreads even a single huge
    file over all tasks. Either way a line is looked up in one step.
    """
    keys = chosen.select("subfolder", "file", "line_no")
    place = (F.col("line_no") % STRETCH).cast("int")
    stretch = F.floor(F.col("line_no") / STRETCH)
    packed = materialize(
        keys.groupBy("subfolder", "file", stretch.alias("_stretch")).agg(
            F.bitmap_construct_agg(place).alias("_bits")
        ),
        "selected",
    )
    names = F.coalesce(F.sum(F.octet_length("subfolder") + F.octet_length("file")), F.lit(0))
    if packed.agg(F.count("*") * STRETCH_BYTES + names).head()[0] > PACKED_BYTES:
        return source.join(keys, list(LINE_KEY), "left_semi")
    held = source.withColumn("_stretch", stretch).join(
        F.broadcast(packed), ["subfolder", "file", "_stretch"]
    )
    byte = F.conv(F.hex(F.expr(f"substring(_bits, CAST(line_no % {STRETCH} DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    bit = F.getbit(byte, (F.col("line_no") % 8).cast("int"))
    return held.where(bit == 1).select(*source.columns)


def select_lines(source: DataFrame, meta: DataFrame, flag: str = "selection") -> DataFrame:
    """Source lines that ``meta`` flags as selected."""
    return lines_of(source, meta.where(is_selected(F.col(flag))))


def output_name(subfolder: Column, file: Column) -> Column:
    return F.concat_ws("_", subfolder, file)
