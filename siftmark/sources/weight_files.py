"""Weights of an iteration as two small JSON files."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siftmark.operators.weights import AgentWeights


def weight_paths(folder: str, iteration: int) -> tuple[str, str]:
    return (
        f"{folder}/agent_weights_iteration_{iteration}.json",
        f"{folder}/collaborative_weights_iteration_{iteration}.json",
    )


def _read(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path, wholetext=True).where(F.length("value") > 0).head()
    if row is None:
        raise FileNotFoundError(path)
    return row.value


def load_weights(spark: SparkSession, folder: str, iteration: int) -> AgentWeights:
    agent, collaboration = weight_paths(folder, iteration)
    return AgentWeights.from_json(_read(spark, agent), _read(spark, collaboration))


def save_weights(spark: SparkSession, weights: AgentWeights, folder: str, iteration: int) -> None:
    """Write both files (28 numbers) as one-line text outputs on any file system."""
    texts = weights.agent_json(), weights.collaboration_json()
    for path, text in zip(weight_paths(folder, iteration), texts):
        spark.range(1).select(F.lit(text).alias("value")).write.mode("overwrite").text(path)
