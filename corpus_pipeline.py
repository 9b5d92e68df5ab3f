"""From raw documents to packed sequences: five stages, each written as Parquet and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import siftmark
from siftmark.llm import common, exact_dedup, mixing, packing, quality_rules, queries, simhash
from siftmark.session import materialize, scratch, shared_folder

# Python workers need not find the package themselves
cloudpickle.register_pickle_by_value(siftmark)

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def whole_rows(docs: DataFrame) -> DataFrame:
    """(_doc, _key, and what the operators read): rows as structs, so that no column of
    the documents meets one of ours. ``_key`` is the whole row in 128 bits: hashes from
    two seeds, over which values are null as well, since a null alone changes no hash."""
    row = [F.col(f"`{c}`") for c in docs.columns]
    nulls = F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in row])
    return docs.select(
        F.struct(*row).alias("_doc"),
        F.struct(F.xxhash64(F.lit(1), nulls, *row).alias("a"), F.xxhash64(F.lit(2), nulls, *row).alias("b")).alias("_key"),
        *[F.col(c) for c in ("doc_id", "text", "lang", "source")],
    )


def ordered_rows(docs: DataFrame) -> DataFrame:
    """(_row, text): ``_row`` orders rows by doc_id, null last, and tells different rows apart."""
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("_key"))
    return whole_rows(docs).select(row.alias("_row"), "text")


def only(docs: DataFrame, keys: DataFrame, once: bool = False) -> DataFrame:
    """The rows of ``docs`` whose key is in ``keys``; with ``once``, equal rows one time."""
    marked = whole_rows(docs).select("_doc", "_key")
    found = marked.join(keys.select("_key").distinct(), "_key", "left_semi")
    if once and not mixing.all_differ(marked.select("_key"), "_key"):
        found = found.dropDuplicates(["_key"])
    return found.select("_doc.*")


def drop_rejected(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null, empty and short texts go; rows
    that repeat an id are judged each for itself, and null ids without labels."""
    judged = quality_rules.judged(whole_rows(docs), queries.labels(spark, sf_dir), carry=("_key",))
    return only(docs, judged.where("kept"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the most code points,
    then the smallest doc_id, null last. Of equal rows one stays."""
    found = exact_dedup.exact_groups(ordered_rows(docs), "_row")
    return only(docs, found.where("kept").select("_row._key"), once=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the one with the smallest
    doc_id, null last. Of equal rows one stays."""
    found = simhash.near_duplicates(ordered_rows(docs), "_row")
    return only(docs, found.where("_row = component_id").select("_row._key"), once=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each pass over a document that the mix takes.

    A document taken twice has two rows. Where a source's share ends inside a
    document, that pass has the words taken, joined by a space, and their
    n_chars. Documents without words are never taken. Equal rows are taken like
    other documents: what they get together is dealt out to whole ones first.
    """
    rows = whole_rows(docs).withColumn("_size", common.word_count(common.plain_text()))
    sizes = rows.select(F.col("_key").alias("doc_id"), mixing.source_key("source"), F.col("_size").alias("size"))
    sizes = materialize(sizes, "sizes")
    mixed = mixing.mixture(sizes, materialize(mixing.source_targets(sizes), "targets"))
    taken = mixed.groupBy("doc_id", "size", "pass").agg(F.sum("words").alias("_taken"))
    parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_taken") - 1) / F.col("size")))
    passes = taken.withColumn("_part", F.explode(parts)).select(
        F.col("doc_id").alias("_key"),
        F.least("size", F.col("_taken") - F.col("_part") * F.col("size")).cast("int").alias("_words"),
    )
    once = rows if mixing.all_differ(sizes, "doc_id") else rows.dropDuplicates(["_key"])
    joined = common.join_spread(once.select("_doc", "_key", "_size"), common.growing(passes), ["_key"])
    cut = F.col("_words") < F.col("_size")
    found = F.slice(F.regexp_extract_all("_doc.text", F.lit(common.WORD), F.lit(0)), 1, F.col("_words"))
    text = F.when(cut, F.array_join(found, " ")).otherwise(F.col("_doc.text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        length = F.length(text).cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(cut, length).otherwise(F.col("_doc.n_chars"))
    return joined.select(*[new.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document's token ids goes in the packed sequences."""
    return packing.packed_pieces(docs, queries.tokenizer_json(), queries.CAPACITY)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", drop_rejected),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mix sources", mix_sources),
    ("pack", pack),
]

#: The tokenizer and the near copies have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the documents of ``sf_dir``.

    Each result is written to the shared folder and read again; what a stage
    stores on its way is deleted once its result is there.
    """
    docs = queries.documents(spark, sf_dir)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
