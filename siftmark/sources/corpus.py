"""The scored corpus, influence files and cluster folders as tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark.functions.text import file_name, folder_name
from siftmark.sources.lines import JSONL, numbered_lines, scan_lines

RECORD_SCHEMA = (
    "domain string, `attr-fineweb-edu` string, `attr-cc_en_topic` string, epoch double, selection string"
)
NUMBER = r"(?i)\A\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*\z"


def as_fields(columns: str) -> str:
    """A list of columns as the fields of a struct type."""
    return re.sub(r"(?m)(`[^`]+`|\b\w+) (\w+)(?=,|$)", r"\1: \2", columns)


def parse_number(text: Column) -> Column:
    """A double from a JSON number or numeric text; null for anything else.

    Texts are numbers as JSON or a spreadsheet would write them; ``true`` and
    digits grouped by underscores, which some languages also take, are not.
    """
    bare = F.btrim(text, F.lit('"'))
    return F.when(bare.rlike(NUMBER), bare.try_cast("double"))


def parse_records(lines: DataFrame, line: str = "line", score: str | None = None) -> DataFrame:
    """Add the scoring fields of each JSON line.

    ``topic`` stays text, since 3 and 3.0 name different keys. A line that is
    not one JSON object and nothing else has every field null: it is read as
    the only element of a list, followed by a field of our own. ``score`` names
    a score field to read as ``score``, 0 when the line has none.

    The parsed record comes from a generator, which filters do not cross. So a
    line is parsed once, however many conditions read its fields.
    """
    record = RECORD_SCHEMA + (f", `{score}` double" if score else "")
    wrapped = F.concat(F.lit('{"only": ['), F.col(line), F.lit('], "end": 1}'))
    read = F.from_json(wrapped, f"only array<struct<{as_fields(record)}>>, end int")
    parsed = lines.select("*", F.inline(F.array(F.struct(read.alias("_l")))))
    alone = (F.col("_l.end") == 1) & (F.size("_l.only") == 1)
    parsed = parsed.withColumn("_r", F.when(alone, F.get("_l.only", F.lit(0))))
    extra = [F.coalesce(F.col("_r")[score], F.lit(0.0)).alias("score")] if score else []
    return parsed.select(
        *lines.columns,
        F.col("_r.domain").alias("domain"),
        parse_number(F.col("_r")["attr-fineweb-edu"]).alias("edu"),
        F.col("_r")["attr-cc_en_topic"].alias("topic"),
        F.col("_r.epoch").alias("epoch"),
        F.col("_r.selection").alias("selection"),
        *extra,
    )


def read_records(spark: SparkSession, root: str, recursive: bool = False, pattern: str = JSONL) -> DataFrame:
    """Numbered corpus lines with their scoring fields."""
    return parse_records(numbered_lines(spark, root, recursive, pattern))


def influence_key(path: Column) -> tuple[Column, Column]:
    """Family and key from ``topic/topic_3``, ``domain/c4`` or ``edu/edu_bin_0_1``."""
    stem = F.regexp_replace(file_name(path), r"\.jsonl\z", "")
    folder = folder_name(path)
    family = F.when(folder == "edu", "quality").otherwise(folder)
    return family, F.when(folder == "edu", F.replace(stem, F.lit("edu_bin_"), F.lit("quality_"))).otherwise(stem)


def read_influences(spark: SparkSession, base: str, pattern: str = JSONL) -> DataFrame:
    """(family, key, line_no, influence) from the three folders under ``base``.

    A blank or malformed line stops the job; an influence that is missing or
    no list comes out null, to be skipped.
    """
    lines = numbered_lines(spark, base, pattern=pattern)
    family, key = influence_key(F.col("path"))
    text = F.when(F.trim("line") == "", F.raise_error(F.concat(F.lit("blank line in "), "path"))).otherwise(
        F.from_json("line", "influence string", {"mode": "FAILFAST"})["influence"]
    )
    return lines.select(family.alias("family"), key.alias("key"), "line_no", text.alias("_t")).select(
        "family",
        "key",
        "line_no",
        F.when(F.col("_t").startswith("["), F.from_json("_t", "array<double>")).alias("influence"),
    )


def missing_keys(influences: DataFrame, wanted: dict[str, list[str]]) -> list[str]:
    """Categories without any influence line (their weights would not move)."""
    found = {(r.family, r.key) for r in influences.select("family", "key").distinct().collect()}
    return [key for family, keys in wanted.items() for key in keys if (family, key) not in found]


def read_clusters(spark: SparkSession, base: str, first: int, last: int, pattern: str = JSONL) -> DataFrame:
    """(cluster, rank, rank_text, content, tie) of the folders ``clustering-<first..last>``.

    ``tie`` keeps file and line order among equal ranks. Only folders in the
    range are listed; absent ones contribute nothing.
    """
    numbers = ",".join(str(i) for i in range(first, last + 1))
    lines = numbered_lines(spark, f"{base}/{{,subfolder=}}clustering-{{{numbers}}}", pattern=pattern)
    cluster = F.regexp_extract("subfolder", r"\Aclustering-(\d+)\z", 1)
    return (
        lines.withColumn("cluster", cluster.cast("int"))
        .withColumn("_r", F.from_json("line", "rank string, content string"))
        .select(
            "cluster",
            parse_number(F.col("_r.rank")).alias("rank"),
            F.col("_r.rank").alias("rank_text"),
            F.col("_r.content").alias("content"),
            F.concat_ws("#", "file", F.lpad(F.col("line_no").cast("string"), 12, "0")).alias("tie"),
        )
    )


def read_training(spark: SparkSession, path: str, pattern: str = JSONL) -> DataFrame:
    """(path, line_no, content) of training files, for slicing and chunking."""
    lines = numbered_lines(spark, path, pattern=pattern)
    return lines.select("path", "line_no", F.get_json_object("line", "$.content").alias("content"))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return scan_lines(spark, path).select(F.col("line").alias("response"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Gradients or representations stored as parquet."""
    return spark.read.parquet(path)
