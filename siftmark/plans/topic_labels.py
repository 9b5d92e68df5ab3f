"""From cluster folders to labelled documents and a trained topic classifier."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark import fixed_values as fixed
from siftmark.operators import classifier, metrics
from siftmark.operators.annotation import Annotator, build_requests, custom_id, parse_responses
from siftmark.operators.clusters import cluster_window, sample_fixed
from siftmark.operators.joins import join_checked
from siftmark.operators.sampling import split_by_draw
from siftmark.sources.corpus import read_clusters
from siftmark.sources.lines import JSONL, write_lines


def write_requests(spark: SparkSession, base: str, first: int, last: int, output: str, pattern: str = JSONL) -> None:
    """Sampled documents as request lines, one folder per window of clusters."""
    sampled = sample_fixed(read_clusters(spark, base, first, last, pattern), "tie")
    requests = build_requests(sampled, tie="tie").withColumn("window", cluster_window(F.col("cluster")))
    requests.select("window", F.col("request").alias("value")).write.partitionBy("window").text(output)


def write_labels(labels: DataFrame, output: str) -> None:
    """Parsed answers as JSON lines, one folder per window of clusters.

    A field without a value is written as null, and an answer whose id names no
    cluster goes to the folder of windows that are null.
    """
    fields = [F.col(c) for c in ("cluster", "rank", "topic", "selected_topic", "explanation")]
    line = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    window = cluster_window(F.col("cluster").cast("long")).alias("window")
    write_lines(labels.select(window, line.alias("line")), "line", output, ["window"])


def label_documents(requests: DataFrame, annotator: Annotator) -> DataFrame:
    """(custom_id, cluster, rank, topic, selected_topic, explanation) for request lines."""
    return parse_responses(annotator.annotate(requests), keep_id=True)


def labelled_examples(sampled: DataFrame, labels: DataFrame, tie: str = "tie") -> DataFrame:
    """Sampled documents with the topic chosen for their request, and its number.

    One row per answered document: ``tie`` makes the request's id unique, and of
    several answers to one request the least topic counts. Any topic is kept;
    ``known`` says whether it is one that was asked for. An answer without a
    topic gives no row.
    """
    rank = "rank_text" if "rank_text" in sampled.columns else "rank"
    keyed = labels.where(F.col("selected_topic").isNotNull())
    keyed = keyed.groupBy("custom_id").agg(F.min("selected_topic").alias("topic"))
    asked = sampled.withColumn("custom_id", custom_id(F.col("cluster"), F.col(rank), F.col(tie)))
    examples = asked.join(keyed, "custom_id")
    known = F.col("topic").isin(list(fixed.TOPIC_NAMES)).alias("known")
    return join_checked(examples, metrics.label_map(examples, "topic"), ["topic"]).select("*", known)


def fit_and_report(examples: DataFrame, id_col: str, seed: int = 0) -> tuple[PipelineModel, DataFrame]:
    """A class-weighted classifier and its report on the tenth held out."""
    parts = split_by_draw(examples, id_col, 0.9, seed)
    model = classifier.train_classifier(parts.where("part = 'train'"), weighted=True)
    predicted = classifier.predict(model, parts.where("part = 'valid'").select("content", "label"))
    return model, metrics.class_report(metrics.confusion(predicted))
