"""JSON-lines scans with line numbers, and line sinks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftmark.functions.text import file_name, folder_name
from siftmark.operators.joins import join_checked
from siftmark.session import materialize

JSONL = "*.jsonl"
PARTS = "part-*"
SPLIT_ROWS = 1_000_000  # about 200 bytes each


def _text(spark: SparkSession, root: str, recursive: bool, pattern: str) -> DataFrame:
    if not recursive:
        return spark.read.text(f"{root}/*/{pattern}")
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return reader.text(root)


def scan_lines(spark: SparkSession, root: str, recursive: bool = True, pattern: str = JSONL) -> DataFrame:
    """(path, line) of every matching file, at any depth or exactly one folder down."""
    return _text(spark, root, recursive, pattern).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("line")
    )


def _pin_splits(spark: SparkSession) -> None:
    """Keep file splits from changing with the number of live executors."""
    name = "spark.sql.files.minPartitionNum"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(spark.sparkContext.defaultParallelism))


def numbered_lines(
    spark: SparkSession, root: str, recursive: bool = True, pattern: str = JSONL
) -> DataFrame:
    """(path, subfolder, file, line_no, line) with line numbers from zero.

    Big files stay split over many tasks. A first scan counts the lines of
    each split; a line's number is the count of the file's earlier splits plus
    its place in its own split. The counts have one row per split and are
    joined to the lines without shuffling these. Should a later scan be split
    differently, it fails instead of numbering wrongly: a shifted split
    always has a line outside its counted range.
    """
    _pin_splits(spark)
    lines = _text(spark, root, recursive, pattern).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
        F.col("value").alias("line"),
    )
    splits = lines.groupBy("path", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("long"))
    counted = materialize(splits.withColumn("_before", before), "splits")
    joined = join_checked(lines, counted, ["path", "_block"], "left", SPLIT_ROWS)
    place = F.col("_at") - F.col("_first")
    line_no = F.when((place >= 0) & (place < F.col("_n")), F.col("_before") + place).otherwise(
        F.raise_error(F.concat(F.lit("splits changed while numbering "), "path")).cast("long")
    )
    return joined.select(
        "path",
        folder_name(F.col("path")).alias("subfolder"),
        file_name(F.col("path")).alias("file"),
        line_no.alias("line_no"),
        "line",
    )


def with_field(line: Column, name: str, value: Column) -> Column:
    """The JSON object line with the field ``name`` set to a number.

    A field of that name at the line's end, as an earlier run leaves it, is
    replaced, so that running again gives the same line.
    """
    number = r"-?[0-9][0-9.eE+-]*"
    old = rf',?\s*"{re.escape(name)}": {number}(?=(, "(selection|score_[0-9]+)": {number})*\s*\}}\s*\z)'
    clean = F.regexp_replace(F.regexp_replace(line, old, ""), r"\A\{\s*,\s*", "{")
    head = F.regexp_replace(clean, r"\s*\}\s*\z", "")
    comma = F.when(head.rlike(r"\{\s*\z"), "").otherwise(", ")
    return F.concat(head, comma, F.lit(f'"{name}": '), value.cast("string"), F.lit("}"))


def write_files(df: DataFrame, line: str, path: str) -> None:
    """(subfolder, file, line_no, line) rows as one text file for each (subfolder, file).

    Lines are in order, so reading them with ``PARTS`` as the pattern gives
    their numbers again, if these are without gaps.
    """
    keys = ["subfolder", "file"]
    ordered = df.select(*keys, "line_no", F.col(line).alias("value")).repartition(*keys)
    ordered.sortWithinPartitions(*keys, "line_no").select(*keys, "value").write.partitionBy(*keys).text(path)


def write_lines(df: DataFrame, line: str, path: str, partition_by: list[str], mode: str = "errorifexists") -> None:
    """Write a text column, one folder per value of ``partition_by``.

    A scan cannot be overwritten while it is read, so ``path`` is a new folder
    for every iteration; ``mode`` "overwrite" is for what a stopped run left.
    """
    rows = df.select(*partition_by, F.col(line).alias("value")).write.mode(mode)
    rows.option("partitionOverwriteMode", "static").partitionBy(*partition_by).text(path)
