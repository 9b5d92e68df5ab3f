"""Predictions and losses of a model, written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark.operators.metrics import class_report, confusion, token_weighted_loss

PREDICTION = "pred int, logits array<double>, labels int, content string"


def write_predictions(df: DataFrame, path: str) -> None:
    """(pred, logits, label, content) rows as JSON lines, and their report beside them.

    ``<path>/rows`` has a line for each row, ``<path>/report`` one for each line
    of the class report.
    """
    rows = df.select("pred", "logits", F.col("label").alias("labels"), "content")
    rows.write.json(f"{path}/rows")
    cells = confusion(read_predictions(df.sparkSession, path).withColumnRenamed("labels", "label"))
    class_report(cells).coalesce(1).write.json(f"{path}/report")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION).json(f"{path}/rows")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    schema = "place int, name string, precision double, recall double, f1 double, support double"
    return spark.read.schema(schema).json(f"{path}/report")


def write_losses(batches: DataFrame, path: str) -> None:
    """Per-batch (loss, num_tokens) rows, and their token-weighted mean beside them."""
    batches.select("loss", "num_tokens").write.json(f"{path}/batches")
    stored = batches.sparkSession.read.schema("loss double, num_tokens long").json(f"{path}/batches")
    token_weighted_loss(stored).coalesce(1).write.json(f"{path}/summary")


def read_loss_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("num_tokens long, loss double").json(f"{path}/summary")
