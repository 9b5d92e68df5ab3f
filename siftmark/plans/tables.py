"""The stored test tables seen as the inputs the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark import fixed_values as fixed
from siftmark.functions.text import words
from siftmark.operators.ordering import running_total


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _entry(names, index: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), index)


def source_number() -> Column:
    return F.substring("source", 4, 10).cast("int")


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as corpus records; some have no known domain or topic."""
    return table(spark, folder, "documents").select(
        "doc_id",
        "source",
        "lang",
        "text",
        _entry([*fixed.DOMAIN_KEYS, "unknown"], source_number() % 8).alias("domain"),
        ((F.col("n_chars") % 551).cast("double") / 100).alias("edu"),
        (F.col("doc_id") % 14).cast("string").alias("topic"),
        (F.col("doc_id") % 5).cast("double").alias("epoch"),
    )


def influences(spark: SparkSession, folder: str) -> DataFrame:
    """Events as influence lines with two losses each."""
    user = F.col("user_id")
    family = F.col("event_id") % 3
    key = (
        F.when(family == 0, F.concat(F.lit("topic_"), (user % 13).cast("string")))
        .when(family == 1, _entry(fixed.DOMAIN_KEYS, (user % 7).cast("int")))
        .otherwise(_entry(fixed.QUALITY_KEYS, (user % 5).cast("int")))
    )
    return table(spark, folder, "events").select(
        F.when(family == 0, "topic").when(family == 1, "domain").otherwise("quality").alias("family"),
        key.alias("key"),
        F.col("event_id").alias("line_no"),
        F.array(F.col("value") / 100, F.col("value") / 200).alias("influence"),
    )


def clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as cluster members; some lack a rank, some content."""
    doc = F.col("doc_id")
    return table(spark, folder, "documents").select(
        source_number().alias("cluster"),
        F.when(doc % 17 != 0, F.col("n_chars").cast("double")).alias("rank"),
        F.when(doc % 19 != 0, F.col("text")).alias("content"),
        "doc_id",
    )


def event_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Events as big clusters with many equal ranks."""
    return table(spark, folder, "events").select(
        F.col("event_type").alias("cluster"),
        F.floor("value").cast("double").alias("rank"),
        F.col("props").alias("content"),
        "event_id",
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as classifier output: a logit for each value, and a label."""
    logits = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, folder, "embeddings").select("vec_id", logits.alias("logits"), "label")


def gradients(spark: SparkSession, folder: str) -> DataFrame:
    """(ckpt, vec_id, label, vector): each embedding's halves as two checkpoints."""
    halves = F.array(
        *[
            F.struct(F.lit(c).alias("ckpt"), F.slice("embedding", 32 * c + 1, 32).alias("vector"))
            for c in (0, 1)
        ]
    )
    return table(spark, folder, "embeddings").select("vec_id", "label", F.inline(halves))


def document_words(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", words(F.col("text")).alias("tokens"))


def question_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """User turns with the assistant turn right after them.

    Joined on (conv_id, turn), so a conversation of any length spreads out.
    """
    turns = table(spark, folder, "conversations")
    asked = turns.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("question")
    )
    answered = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return asked.join(answered, ["conv_id", "turn"])


def source_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as numbered lines: a folder per source, a file per language."""
    documents = table(spark, folder, "documents")
    keys = running_total(
        documents.select("source", "lang", "doc_id"), "doc_id", groups=("source", "lang"), out="line_no"
    ).select("doc_id", "line_no")
    return documents.join(keys, "doc_id").select(
        F.col("source").alias("subfolder"),
        F.col("lang").alias("file"),
        "line_no",
        "doc_id",
        F.col("text").alias("line"),
    )


def raw_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as JSON lines, a fourteenth each with one kind of flaw."""
    kind = F.col("doc_id") % 14
    edu = F.round(F.col("edu"), 2).cast("string")
    edu_text = (
        F.when(kind == 5, F.concat(F.lit('"'), edu, F.lit('"')))
        .when(kind == 6, "null")
        .when(kind == 7, '"abc"')
        .when(kind == 10, "5.0")
        .otherwise(edu)
    )
    topic = F.when(kind == 4, F.concat("topic", F.lit(".0"))).otherwise(F.col("topic"))
    epoch = (
        F.when(kind == 8, "")
        .when(kind == 9, ', "epoch": -10')
        .when(kind == 11, ', "epoch": "2"')
        .otherwise(F.concat(F.lit(', "epoch": '), F.col("epoch").cast("int").cast("string")))
    )
    domain = F.when(kind == 3, "").otherwise(F.concat(F.lit(', "domain": "'), "domain", F.lit('"')))
    content = F.to_json(F.struct(F.col("text").alias("content")))
    line = F.concat(
        F.regexp_replace(content, r"\}\z", ""),
        domain,
        F.lit(', "attr-fineweb-edu": '), edu_text,
        F.lit(', "attr-cc_en_topic": '), topic,
        epoch,
        F.when(kind == 1, "").otherwise("}"),
    )
    flawed = F.when(kind == 2, "").when(kind == 12, F.concat(line, F.lit(" junk")))
    return records(spark, folder).select(
        "doc_id", flawed.when(kind == 13, F.concat_ws(" ", line, line)).otherwise(line).alias("line")
    )


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as annotator responses, some without choices or with an odd id."""
    doc = F.col("doc_id")
    rank = F.when(doc % 7 == 0, "None").otherwise(F.col("n_chars").cast("string"))
    answer = F.to_json(
        F.struct(
            F.col("lang").alias("topic"),
            _entry(fixed.TOPIC_NAMES, (doc % 13).cast("int")).alias("selected topic"),
            F.col("text").alias("explanation"),
        )
    )
    choice = F.struct(F.struct(answer.alias("content")).alias("message"))
    choices = F.when(doc % 11 != 0, F.array(choice)).otherwise(F.slice(F.array(choice), 1, 0))
    line = F.struct(
        F.concat(F.lit("task-cluster-"), source_number().cast("string"), F.lit("-rank-"), rank).alias("custom_id"),
        F.struct(F.struct(choices.alias("choices")).alias("body")).alias("response"),
    )
    return table(spark, folder, "documents").select("doc_id", F.to_json(line).alias("response"))


def item_words(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items with their words, from which task items are made."""
    return table(spark, folder, "benchmark").select(
        "item_id", "text", words(F.col("text")).alias("w")
    )
