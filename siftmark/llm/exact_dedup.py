"""Exact duplicates by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own characters say so, at the end of a sentence once a
chunk has its least length. Chunks get identifiers: the hash of the chunk, and
where different chunks share a hash, also their rank among these. Only chunks
are compared as text, each moved once and only its distinct copies of a task;
documents are then compared by their ordered identifier lists, a few bytes for
each chunk however long the document is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmark.llm.common import SPACE, join_spread, plain_text
from siftmark.session import materialize

LEAST, MOST = 256, 4096
#: A chunk of LEAST to MOST characters that ends a sentence, else what is left, at most MOST.
CHUNK = rf"(?s).{{{LEAST},{MOST - 1}}}?[.!?;:。！？।]|.{{1,{MOST}}}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, "")


def _chunks(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.regexp_extract_all(normalised(plain_text(text)), F.lit(CHUNK), F.lit(0)).alias("_chunks"))


def clashes(docs: DataFrame, text: str, chunk_hash: Callable[[Column], Column]) -> DataFrame:
    """(hash, chunk, variant) of the chunks whose hash belongs to several texts."""
    distinct = (
        _chunks(docs, text)
        .select(F.explode("_chunks").alias("chunk"))
        .distinct()
        .withColumn("hash", chunk_hash(F.col("chunk")))
    )
    shared = distinct.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    variant = F.row_number().over(Window.partitionBy("hash").orderBy("chunk"))
    return distinct.join(shared, "hash").withColumn("variant", variant.cast("long"))


def recipes(
    docs: DataFrame, text: str = "text", chunk_hash: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """``docs`` with ``recipe``: the ordered identifiers of its chunks, equal
    exactly for texts that are equal without white space.

    The hashes are checked first: one pass compares the distinct chunks of the
    corpus as text. Nearly always no two share a hash, and the hash alone is the
    identifier. Otherwise documents that hold such a chunk add its variants.
    """
    hashes = F.transform(
        F.regexp_extract_all(normalised(plain_text(text)), F.lit(CHUNK), F.lit(0)), lambda x: chunk_hash(x)
    )
    clash = materialize(clashes(docs, text, chunk_hash), "clashing-chunks")
    if clash.isEmpty():
        return docs.withColumn("recipe", hashes)
    keyed = docs.withColumn("_key", F.sha2(F.to_json(F.struct(*docs.columns)), 256))
    pieces = keyed.select(
        "_key",
        F.posexplode(
            F.regexp_extract_all(normalised(plain_text(text)), F.lit(CHUNK), F.lit(0))
        ).alias("_at", "chunk"),
    ).withColumn("hash", chunk_hash(F.col("chunk")))
    found = F.array_sort(F.collect_set(F.struct("_at", "variant")))
    variants = (
        join_spread(pieces, clash, ["hash", "chunk"])
        .groupBy("_key")
        .agg(F.transform(found, lambda x: x["variant"]).alias("_more"))
    )
    more = F.coalesce("_more", F.array().cast("array<bigint>"))
    length = F.array(F.size(hashes).cast("long"))
    return (
        keyed.join(variants, "_key", "left")
        .withColumn("recipe", F.concat(hashes, length, more))
        .select(*docs.columns, "recipe")
    )


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    chunk_hash: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """Every row's id with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Of rows equal without ASCII white space, the one with the most code points
    stays, then the smallest id. Null text counts as empty; empty texts form one
    group. Rows that repeat an id are rows of the group like others and share
    its verdict; a null id comes after all others and is kept only where its
    group has no other id. An empty table gives none. Other columns are ignored.
    """
    named = docs.select(F.col(id_col).alias("_id"), plain_text(text).alias("_text"))
    made = recipes(named, "_text", chunk_hash).select(
        "_id",
        F.length("_text").cast("long").alias("_points"),
        F.sha2(normalised(F.col("_text")).cast("binary"), 256).alias("text_sha256"),
        "recipe",
    )
    made = materialize(made, "recipes")
    best = F.min(F.struct(-F.col("_points"), F.col("_id").isNull(), F.col("_id").alias("_id")))
    groups = (
        made.groupBy("recipe")
        .agg(best.alias("_best"), F.count("*").alias("group_size"))
        .select("recipe", F.col("_best._id").alias("keep_id"), "group_size")
    )
    return join_spread(made, groups, ["recipe"]).select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )
