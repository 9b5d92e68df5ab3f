"""Queries through the remaining readers and writers of files, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmark import fixed_values as fixed
from siftmark.functions.text import file_name, folder_name, words
from siftmark.operators import annotation
from siftmark.operators.ordering import running_total
from siftmark.plans import gradient_scores, oracles, tables, topic_labels
from siftmark.plans.file_queries import _whole_lines, _written_corpus, fresh, written_clusters, written_mmlu
from siftmark.plans.queries import query, r6
from siftmark.plans.tables import table
from siftmark.sources import corpus, evaluation
from siftmark.sources.lines import PARTS, scan_lines, write_files, write_lines

SQL: dict[str, str] = {}
ORACLES = oracles.oracle_sql()
MESSAGES = "body struct<messages: array<struct<role: string, content: string>>>"
LABEL = "cluster string, rank string, topic string, selected_topic string, explanation string"


@query
def file_one_level(spark, folder):
    """Files one folder down; every fifth document lies deeper and is not read."""
    path = fresh(spark, "one-level")
    docs = table(spark, folder, "documents").join(_whole_lines(spark, folder), "doc_id")
    docs = docs.select(F.col("source").alias("subfolder"), F.col("lang").alias("file"), "doc_id", "line")
    write_lines(docs.where("doc_id % 5 <> 0"), "line", path, ["subfolder"])
    write_lines(docs.where("doc_id % 5 = 0"), "line", path, ["subfolder", "file"], "append")
    lines = scan_lines(spark, path, recursive=False, pattern=PARTS)
    return lines.select(folder_name(F.col("path")).alias("subfolder"), F.get_json_object("line", "$.content").alias("content"))


SQL["file_one_level"] = "SELECT source AS subfolder, text AS content FROM documents WHERE doc_id % 5 <> 0"


def _training(spark, folder):
    read = corpus.read_training(spark, _written_corpus(spark, folder, _whole_lines(spark, folder), "training"), PARTS)
    return read.select(
        folder_name(F.col("path")).alias("subfolder"), file_name(F.col("path")).alias("file"), "line_no", "content"
    )


@query
def file_training(spark, folder):
    return _training(spark, folder)


SQL["file_training"] = f"WITH {oracles.PLACED} SELECT source AS subfolder, lang AS file, line_no, text AS content FROM placed"


@query
def file_training_chunks(spark, folder):
    """The first slice of every training file in overlapping windows of 512 words."""
    keys = ("subfolder", "file")
    chunks = gradient_scores.training_chunks(_training(spark, folder), words, 512, slice_no=0, file_keys=keys)
    return chunks.select(*keys, "line_no", "chunk_no", "start", F.array_join("input_ids", " ").alias("input_ids"))


SQL["file_training_chunks"] = f"""WITH {oracles.PLACED}, {oracles.TOKENS}
SELECT p.source AS subfolder, p.lang AS file, p.line_no, CAST(k AS INTEGER) AS chunk_no, CAST(k * 384 AS INTEGER) AS start,
  array_to_string(w[k * 384 + 1 : k * 384 + 512], ' ') AS input_ids
FROM tokens JOIN placed p USING (doc_id), unnest(range(0, (len(w) + 383) // 384)) AS t(k)
WHERE p.line_no + 1 < {fixed.SLICE_ROWS}"""


@query
def file_items(spark, folder):
    """A split stored as several parquet files, numbered over all of them."""
    path = fresh(spark, "items")
    items = table(spark, folder, "benchmark").repartitionByRange(4, "item_id").sortWithinPartitions("item_id")
    items.write.parquet(path)
    return evaluation.read_items(spark, path).select("item_no", "item_id", "text")


@query
def file_json_items(spark, folder):
    """The same split as one file of JSON lines."""
    path = fresh(spark, "json-items")
    rows = running_total(table(spark, folder, "benchmark"), "item_id", out="line_no")
    line = F.to_json(F.struct("item_id", "text"))
    write_files(rows.select(F.lit("benchmark").alias("subfolder"), F.lit("test").alias("file"), "line_no", line.alias("line")), "line", path)
    read = evaluation.read_json_items(spark, path, "item_id long, text string", PARTS)
    return read.select("item_no", "item_id", "text")


SQL["file_items"] = SQL["file_json_items"] = (
    "SELECT CAST(row_number() OVER (ORDER BY item_id) - 1 AS BIGINT) AS item_no, item_id, text FROM benchmark"
)


@query
def file_matched(spark, folder):
    """``match_multi_ckpt`` from stored vectors to stored scores."""
    rows = tables.gradients(spark, folder)
    train, validation, output = (fresh(spark, f"vectors-{n}") for n in ("train", "validation", "scores"))
    rows.where("vec_id >= 54").withColumnRenamed("vec_id", "train_id").write.parquet(train)
    rows.where("vec_id < 54").withColumnRenamed("vec_id", "position").write.parquet(validation)
    gradient_scores.match_stored(spark, train, validation, "bbh", {0: 2.0, 1: 3.0}, output)
    return spark.read.parquet(output).select("train_id", r6("score").alias("score"))


SQL["file_matched"] = ORACLES["match_multi_ckpt"]


@query
def file_requests(spark, folder):
    """Request lines of sampled clusters, by window, as they were written."""
    path = fresh(spark, "requests")
    topic_labels.write_requests(spark, written_clusters(spark, folder), 0, 99, path, PARTS)
    lines = spark.read.option("basePath", path).text(path)
    messages = F.from_json("value", MESSAGES)["body"]["messages"]
    read = lines.select(F.col("window").cast("long").alias("window"), "value", messages.alias("m"))
    name = F.regexp_extract(F.get_json_object("value", "$.custom_id"), "^(task-cluster-[0-9]+-rank-[^-]+)-doc-", 1)
    return read.select(
        "window", name.alias("name"), F.get("m", F.lit(0))["content"].alias("prompt"), F.get("m", F.lit(1))["content"].alias("content")
    )


SQL["file_requests"] = f"""WITH {oracles.MEMBERS}
SELECT CAST(cluster // {fixed.CLUSTER_WINDOW} * {fixed.CLUSTER_WINDOW} AS BIGINT) AS window,
  'task-cluster-' || cluster || '-rank-' || coalesce(CAST(rank AS VARCHAR), 'None') AS name,
  {oracles._text(fixed.ANNOTATOR_PROMPT)} AS prompt, content
FROM ordered WHERE i % CAST(ceil(n / 10.0) AS BIGINT) = 0 AND content IS NOT NULL"""


def _recorded(spark, folder):
    """Parsed answers, recorded for all documents, to the requests of a third of them."""
    path = fresh(spark, "responses")
    tables.responses(spark, folder).select("response").write.text(path)
    rank = F.when(F.col("doc_id") % 7 != 0, F.col("n_chars").cast("string"))
    asked = table(spark, folder, "documents").where("doc_id % 3 = 0").select(
        tables.source_number().alias("cluster"), rank.alias("rank_text"), F.col("text").alias("content")
    )
    requests = annotation.build_requests(asked).select("request")
    return topic_labels.label_documents(requests, annotation.RecordedAnnotator(path))


@query
def recorded_answers(spark, folder):
    return _recorded(spark, folder).select("custom_id", "selected_topic", "explanation")


ANSWERED = f"""ids AS (
  SELECT *, CAST(substr(source, 4) AS INTEGER) AS cluster, CASE WHEN doc_id % 7 <> 0 THEN CAST(n_chars AS VARCHAR) END AS rank FROM documents),
named AS (SELECT *, 'task-cluster-' || cluster || '-rank-' || coalesce(rank, 'None') AS custom_id FROM ids),
answered AS (
  SELECT custom_id, CASE WHEN rank IS NOT NULL THEN CAST(cluster AS VARCHAR) END AS cluster, rank,
    CASE WHEN doc_id % 11 <> 0 THEN lang END AS topic,
    CASE WHEN doc_id % 11 <> 0 THEN {oracles._list(fixed.TOPIC_NAMES)}[doc_id % 13 + 1] END AS selected_topic,
    CASE WHEN doc_id % 11 <> 0 THEN text END AS explanation
  FROM named WHERE custom_id IN (SELECT custom_id FROM named WHERE doc_id % 3 = 0))"""
SQL["recorded_answers"] = f"WITH {ANSWERED} SELECT custom_id, selected_topic, explanation FROM answered"


@query
def labels_written(spark, folder):
    """Parsed answers as lines, by window of clusters, and read again."""
    path = fresh(spark, "labels")
    topic_labels.write_labels(_recorded(spark, folder), path)
    lines = spark.read.option("basePath", path).text(path)
    whole = F.size(F.json_object_keys("value")) == 5
    return lines.select(F.col("window").cast("long").alias("window"), whole.alias("whole"), F.from_json("value", LABEL).alias("v")).select(
        "window", "whole", "v.*"
    )


SQL["labels_written"] = f"""WITH {ANSWERED}
SELECT CAST(CAST(cluster AS INTEGER) // {fixed.CLUSTER_WINDOW} * {fixed.CLUSTER_WINDOW} AS BIGINT) AS window, true AS whole,
  cluster, rank, topic, selected_topic, explanation FROM answered"""


@query
def file_mmlu_dev(spark, folder):
    """The first five rows of each subject's development file."""
    read = evaluation.read_mmlu(spark, written_mmlu(spark, folder, "dev"), "dev", 5, PARTS)
    return read.select("subject", "row_no", "question", F.array_join("options", "|").alias("options"), "answer")


SQL["file_mmlu_dev"] = ORACLES["file_mmlu"].replace("<= 10", "<= 5")
