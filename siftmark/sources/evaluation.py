"""Evaluation sets as the item tables that the prompt operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftmark.functions.text import file_name
from siftmark.operators.joins import join_checked
from siftmark.sources.lines import JSONL, numbered_lines

MMLU_LETTERS = ("a", "b", "c", "d")


def read_bbh(spark: SparkSession, path: str) -> DataFrame:
    """(task, text) from one JSON object of task texts."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("task", "text"))


def read_tydiqa(spark: SparkSession, path: str) -> DataFrame:
    """(language, context, question, answer): each language's first example."""
    item = "struct<context: string, question: string, answers: array<struct<text: string>>>"
    whole = spark.read.text(path, wholetext=True)
    examples = whole.select(
        F.explode(F.from_json("value", f"map<string,array<{item}>>")).alias("language", "examples")
    ).withColumn("e", F.get("examples", F.lit(0)))
    return examples.select(
        "language", "e.context", "e.question", F.get("e.answers.text", F.lit(0)).alias("answer")
    )


def read_mmlu(
    spark: SparkSession, folder: str, split: str = "test", first: int = 10, pattern: str | None = None
) -> DataFrame:
    """(subject, row_no, question, options, answer): the first rows of each subject's file."""
    columns = ["question", *MMLU_LETTERS, "answer"]
    schema = ", ".join(f"{c} string" for c in columns)
    rows = (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("escape", '"')
        .option("pathGlobFilter", pattern or f"*_{split}.csv")
        .option("recursiveFileLookup", True)
        .csv(folder)
        .select("*", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("_at"))
    )
    # a file with line breaks in quotes is read by one task, so its rows are few
    in_file = F.row_number().over(Window.partitionBy("path").orderBy("_at")) - 1
    return (
        rows.withColumn("row_no", in_file)
        .where(F.col("row_no") < first)
        .select(
            F.regexp_replace(file_name(F.col("path")), rf"_{split}\.csv\z", "").alias("subject"),
            "row_no",
            "question",
            F.array(*MMLU_LETTERS).alias("options"),
            "answer",
        )
    )


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """A task's split stored as parquet, with ``item_no`` in file, then row order."""
    items = spark.read.parquet(path)
    rows = items.select(
        "*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row")
    )
    files = rows.groupBy("_path").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    starts = files.select("_path", F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("long")).alias("_s"))
    # a key per file would put a large file in one task
    return join_checked(rows, starts, ["_path"], "left").select(
        *items.columns, (F.col("_s") + F.col("_row")).alias("item_no")
    )


def read_json_items(spark: SparkSession, path: str, schema: str, pattern: str = JSONL) -> DataFrame:
    """A task's split stored as one JSON-lines file, with ``item_no``."""
    lines = numbered_lines(spark, path, pattern=pattern)
    return lines.select(F.from_json("line", schema).alias("r"), F.col("line_no").alias("item_no")).select(
        "r.*", "item_no"
    )
