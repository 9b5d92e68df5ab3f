"""Queries over joins by interval, products in blocks, batches, table functions and data sources, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmark import fixed_values as fixed
from siftmark.functions.table_functions import register_chunks
from siftmark.operators import annotation, batches, intervals, matching, sequences
from siftmark.operators.weights import AgentWeights
from siftmark.plans import oracles, tables
from siftmark.plans.annotation_jobs import completed_labels, request_states, run_windows
from siftmark.plans.file_queries import BUNDLE, fresh
from siftmark.plans.queries import query, r6
from siftmark.plans.tables import table
from siftmark.sources.packed import bundled_together
from siftmark.sources.packed_source import register_packed
from siftmark.streaming.folded_losses import folded_weights, follow_losses

SQL: dict[str, str] = {}


@query
def match_blocked(spark, folder):
    """``match_multi_ckpt`` as a product in blocks, several of rows, centres and dimensions."""
    rows = tables.gradients(spark, folder)
    validation = rows.where(F.col("vec_id") < 54).withColumn("position", F.col("vec_id"))
    train = rows.where(F.col("vec_id") >= 54).withColumnRenamed("vec_id", "train_id")
    scores = matching.match_blocked(train, validation, fixed.SUBTASKS["bbh"], {0: 2.0, 1: 3.0}, 512, 10, 24)
    return scores.select("train_id", r6("score").alias("score"))


SQL["match_blocked"] = oracles.oracle_sql()["match_multi_ckpt"]


@query
def quality_range_join(spark, folder):
    """The first order, by key, whose range of prices holds half the price of an order."""
    ranges = table(spark, folder, "orders").select(
        "o_orderkey",
        F.col("o_totalprice").cast("double").alias("low"),
        (F.col("o_totalprice").cast("double") + F.col("o_orderkey") % 7 * 1000).alias("high"),
    )
    halves = table(spark, folder, "orders").select("o_orderkey", (F.col("o_totalprice").cast("double") / 2).alias("price"))
    found = intervals.first_interval(halves, ranges.withColumnRenamed("o_orderkey", "first_order"), "o_orderkey", "price", "first_order")
    return found.select("o_orderkey", "first_order")


SQL["quality_range_join"] = """
WITH ranges AS (
  SELECT o_orderkey, o_totalprice::DOUBLE AS low, o_totalprice::DOUBLE + o_orderkey % 7 * 1000 AS high FROM orders),
halves AS (SELECT o_orderkey, o_totalprice::DOUBLE / 2 AS price FROM orders)
SELECT h.o_orderkey, min(r.o_orderkey) AS first_order
FROM halves h LEFT JOIN ranges r ON h.price >= r.low AND h.price < r.high GROUP BY h.o_orderkey"""


@query
def udtf_chunks(spark, folder):
    """``chunk_overlap`` by a table function in SQL."""
    register_chunks(spark)
    words = tables.document_words(spark, folder).select("doc_id", "tokens")
    words.createOrReplaceTempView("words_of_documents")
    return spark.sql(
        """SELECT doc_id, chunk_no, start, array_join(input_ids, ' ') AS input_ids
        FROM overlap_chunks(TABLE(words_of_documents) PARTITION BY (doc_id), 'tokens', 512)"""
    )


SQL["udtf_chunks"] = oracles.oracle_sql()["chunk_overlap"]


@query
def length_grouped_batches(spark, folder):
    """Documents in batches of 32 of like length, by language, and what they are padded to."""
    docs = tables.document_words(spark, folder).select("doc_id", F.size("tokens").alias("words"))
    docs = docs.join(table(spark, folder, "documents").select("doc_id", "lang"), "doc_id")
    return batches.length_grouped_batches(docs, "doc_id", "words", 32, 11, "lang")


SQL["length_grouped_batches"] = """
WITH drawn AS (
  SELECT doc_id, lang, CAST(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT) AS words,
         md5('11:' || doc_id) AS draw FROM documents),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY words, substr(draw, 1, 13), doc_id) - 1 AS r FROM drawn),
cut AS (SELECT *, r // 32 AS nth, r % 32 AS place FROM ranked),
batches AS (
  SELECT lang, nth, max(words) AS padded,
         row_number() OVER (ORDER BY substr(md5('11:batch:' || min(doc_id)), 1, 13), min(doc_id)) - 1 AS batch
  FROM cut GROUP BY lang, nth)
SELECT doc_id, words, lang, batch, place, padded FROM cut JOIN batches USING (lang, nth)"""


@query
def file_packed_source(spark, folder):
    """``file_packed`` by the data source, read in blocks."""
    register_packed(spark)
    lengths = tables.document_words(spark, folder).withColumn("tokens", F.transform("tokens", F.length))
    chunks = sequences.pack_tokens(lengths, "doc_id", "tokens", 512, F.lit(0))
    path = fresh(spark, "packed-source")
    writer = bundled_together(chunks, BUNDLE).write.format("packed").option("vocabulary", 40_000).option("bundle", BUNDLE)
    writer.mode("overwrite").save(path)
    read = spark.read.format("packed").option("blockSize", 200).load(path)
    parts = read.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("block_no", "tokens"))).alias("parts"))
    tokens = F.flatten(F.transform("parts", lambda x: x["tokens"]))  # a chunk's own blocks
    return parts.select("chunk_id", F.array_join(tokens, " ").alias("tokens"))


SQL["file_packed_source"] = oracles.oracle_sql()["file_packed"]


@query
def stream_ewma(spark, folder):
    """``ewma_weights`` from a stream: several micro-batches, a part of the lines twice."""
    lines = tables.influences(spark, folder)
    arrived, output, checkpoint = (fresh(spark, f"stream-{n}") for n in ("lines", "folded", "checkpoint"))
    for arrival in ("line_no % 3 > 0", "line_no % 2 = 0", "line_no % 6 = 3"):
        lines.where(arrival).repartition(2, "line_no").write.mode("append").parquet(arrived)
        stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 2).parquet(arrived)
        follow_losses(stream, output, checkpoint).awaitTermination()
    return folded_weights(spark, output, AgentWeights()).select("family", "key", "n", r6("weight").alias("weight"))


SQL["stream_ewma"] = oracles.oracle_sql()["ewma_weights"]


class OfflineAnnotator:
    """Answers from the request itself; some documents only when asked again, some never."""

    def annotate(self, requests):
        doc = F.regexp_extract("custom_id", "-doc-([0-9]+)$", 1).cast("long")
        content = F.get_json_object("request", "$.body.messages[1].content")
        answer = F.to_json(F.struct(F.concat(F.lit("t"), doc % 13).alias("selected topic"), F.length(content).cast("string").alias("explanation")))
        message = F.struct(F.struct(answer.alias("content")).alias("message"))
        given = (doc % 4 != 3) & ((doc % 4 != 1) | (F.col("attempt") > 1))
        body = F.struct(F.when(given, F.array(message)).otherwise(F.array().cast("array<struct<message:struct<content:string>>>")).alias("choices"))
        lines = requests.where(doc % 8 != 7).select("custom_id", F.struct(body.alias("body")).alias("response"))
        return lines.select(F.to_json(F.struct("custom_id", "response")).alias("response"))


@query
def annotation_resumed(spark, folder):
    """Requests for all documents in four windows; the first run is stopped after one attempt at two of them."""
    docs = table(spark, folder, "documents").select("doc_id", F.col("text").alias("content"), (F.col("doc_id") % 5).alias("cluster"), F.col("doc_id").alias("rank"))
    requests = annotation.build_requests(docs, tie="doc_id").select((F.col("cluster") % 4).cast("int").alias("window"), "request")
    path = fresh(spark, "annotation")
    run_windows(requests, OfflineAnnotator(), path, [0, 1], attempts=1)
    run_windows(requests, OfflineAnnotator(), path, range(4))
    doc = F.regexp_extract("custom_id", "-doc-([0-9]+)$", 1).cast("long")
    states = request_states(spark, path).select(doc.alias("doc_id"), "window", "state", "attempts")
    labels = completed_labels(spark, path).select(doc.alias("doc_id"), "selected_topic", F.col("explanation").cast("long").alias("chars"))
    return states.join(labels, "doc_id", "left")


SQL["annotation_resumed"] = """
SELECT doc_id, CAST(doc_id % 5 % 4 AS INTEGER) AS window, CASE WHEN doc_id % 4 = 3 THEN 'failed' ELSE 'completed' END AS state,
  CAST(CASE doc_id % 4 WHEN 3 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS INTEGER) AS attempts,
  CASE WHEN doc_id % 4 <> 3 THEN 't' || (doc_id % 13) END AS selected_topic,
  CASE WHEN doc_id % 4 <> 3 THEN CAST(length(text) AS BIGINT) END AS chars
FROM documents"""
