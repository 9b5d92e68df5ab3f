"""Requests to an external topic annotator and its parsed answers."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark import fixed_values as fixed

RESPONSE_SCHEMA = (
    "custom_id string, response struct<body: struct<choices: "
    "array<struct<message: struct<content: string>>>>>"
)
ANSWER_SCHEMA = "topic string, `selected topic` string, explanation string"


class Annotator(Protocol):
    """Sends request lines to a service and returns response lines.

    The service and its credentials stay outside this package.
    """

    def annotate(self, requests: DataFrame) -> DataFrame:
        """From a ``request`` column of JSON to a ``response`` column of JSON."""
        ...


class RecordedAnnotator:
    """Answers from a folder of earlier response files."""

    def __init__(self, path: str):
        self.path = path

    def annotate(self, requests: DataFrame) -> DataFrame:
        recorded = requests.sparkSession.read.text(self.path).select(
            F.col("value").alias("response"),
            F.get_json_object("value", "$.custom_id").alias("custom_id"),
        )
        wanted = requests.select(F.get_json_object("request", "$.custom_id").alias("custom_id"))
        return recorded.join(wanted, "custom_id", "left_semi").select("response")


def custom_id(cluster: Column, rank: Column, tie: Column | None = None) -> Column:
    """The request's id. ``tie`` tells documents of a cluster with equal or missing
    ranks apart; parsers that look for cluster and rank only do not see it."""
    more = [] if tie is None else [F.lit("-doc-"), tie.cast("string")]
    return F.concat(
        F.lit("task-cluster-"),
        F.coalesce(cluster.cast("string"), F.lit("None")),
        F.lit("-rank-"),
        F.coalesce(rank.cast("string"), F.lit("None")),
        *more,
    )


def build_requests(
    sampled: DataFrame,
    prompt: str = fixed.ANNOTATOR_PROMPT,
    model: str = fixed.ANNOTATOR_MODEL,
    temperature: float = fixed.ANNOTATOR_TEMPERATURE,
    tie: str | None = None,
) -> DataFrame:
    """Add ``request``: one chat-completion batch line per sampled document.

    The id carries ``rank_text`` (the rank as its file writes it) if there is
    one, and the column ``tie`` where ranks do not tell documents apart.
    """
    rank = "rank_text" if "rank_text" in sampled.columns else "rank"

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    body = F.struct(
        F.lit(model).alias("model"),
        F.lit(temperature).alias("temperature"),
        F.struct(F.lit("json_object").alias("type")).alias("response_format"),
        F.array(message("system", F.lit(prompt)), message("user", F.col("content"))).alias("messages"),
    )
    line = F.struct(
        custom_id(F.col("cluster"), F.col(rank), F.col(tie) if tie else None).alias("custom_id"),
        F.lit("POST").alias("method"),
        F.lit(fixed.ANNOTATOR_URL).alias("url"),
        body.alias("body"),
    )
    return sampled.withColumn("request", F.to_json(line))


def parse_responses(
    responses: DataFrame, column: str = "response", keep_id: bool = False, keep: Sequence[str] = ()
) -> DataFrame:
    """(cluster, rank, topic, selected_topic, explanation), all text.

    An id of another shape leaves cluster and rank null; no choices, or an
    answer that is not JSON, leave the topic fields null. ``keep_id`` adds the
    whole custom_id, which also tells fractional ranks apart; ``keep`` names
    columns to pass on.
    """
    parsed = responses.select(*keep, F.from_json(column, RESPONSE_SCHEMA).alias("r"))
    content = F.get("r.response.body.choices", F.lit(0))["message"]["content"]
    fields = parsed.select(*keep, F.col("r.custom_id").alias("id"), content.alias("content"))

    def group(n: int) -> Column:
        return F.nullif(F.regexp_extract("id", fixed.CUSTOM_ID_PATTERN, n), F.lit(""))

    answers = fields.select(
        *keep,
        "id",
        group(1).alias("cluster"),
        group(2).alias("rank"),
        F.from_json("content", ANSWER_SCHEMA).alias("a"),
    )
    kept = [F.col("id").alias("custom_id")] if keep_id else []
    return answers.select(
        *keep,
        *kept,
        "cluster",
        "rank",
        F.col("a.topic").alias("topic"),
        F.col("a")["selected topic"].alias("selected_topic"),
        F.col("a.explanation").alias("explanation"),
    )
