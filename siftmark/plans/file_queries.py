"""Queries that go through files: the stored tables are written in the layouts that
the readers take, read back with these, and processed."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark import fixed_values as fixed
from siftmark.functions import text
from siftmark.operators import clusters, influence, metrics, providers, scoring, selection, sequences, weights
from siftmark.operators.ordering import running_total
from siftmark.plans import tables
from siftmark.plans.queries import ladder, query, r6
from siftmark.plans.selection_round import Round, flag_lines, move_weights, published, resume_round, run_round, write_scores
from siftmark.plans.tables import table
from siftmark.session import shared_folder
from siftmark.sources import corpus, evaluation, packed, predictions
from siftmark.sources.lines import PARTS, numbered_lines, with_field, write_files
from siftmark.sources.manifests import write_mark
from siftmark.sources.weight_files import load_weights, save_weights


def fresh(spark: SparkSession, label: str) -> str:
    """A new folder, in the shared one, for the files of one run."""
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")


def _placed(spark, folder) -> DataFrame:
    """(doc_id, subfolder, file, line_no): a folder per source, a file per language."""
    return tables.source_lines(spark, folder).drop("line")


def _written_corpus(spark, folder, lines: DataFrame, label: str) -> str:
    """The folder in which (doc_id, line) rows are files."""
    path = fresh(spark, label)
    write_files(_placed(spark, folder).join(lines, "doc_id"), "line", path)
    return path


def _whole_lines(spark, folder) -> DataFrame:
    """Documents as flawless corpus lines."""
    fields = F.struct(
        F.col("text").alias("content"),
        "domain",
        F.col("edu").alias("attr-fineweb-edu"),
        F.col("topic").cast("int").alias("attr-cc_en_topic"),
        "epoch",
    )
    return tables.records(spark, folder).select("doc_id", F.to_json(fields).alias("line"))


def _written_influences(spark, folder) -> str:
    path = fresh(spark, "influences")
    rows = tables.influences(spark, folder)
    quality = F.col("family") == "quality"
    write_files(
        rows.select(
            F.when(quality, "edu").otherwise(F.col("family")).alias("subfolder"),
            F.when(quality, F.replace("key", F.lit("quality_"), F.lit("edu_bin_"))).otherwise(F.col("key")).alias("file"),
            "line_no",
            F.to_json(F.struct("influence")).alias("line"),
        ),
        "line",
        path,
    )
    return path


@query
def file_scores(spark, folder):
    path = _written_corpus(spark, folder, tables.raw_lines(spark, folder), "corpus")
    scored = scoring.score_records(corpus.read_records(spark, path, True, PARTS), ladder())
    return scored.select("subfolder", "file", "line_no", r6("score_1").alias("score"))


@query
def file_influences(spark, folder):
    lines = corpus.read_influences(spark, _written_influences(spark, folder), PARTS)
    folded = weights.fold_losses(lines, weights.AgentWeights())
    return folded.select("family", "key", "n", r6("weight").alias("weight"))


@query
def file_flags(spark, folder):
    """Flags of lines that carry their score; every seventh line has none and counts as 0."""
    score = with_field(F.col("line"), "score_1", F.col("doc_id") % 101)
    lines = _whole_lines(spark, folder).withColumn("line", F.when(F.col("doc_id") % 7 != 0, score).otherwise(F.col("line")))
    path = _written_corpus(spark, folder, lines, "scored")
    flagged = flag_lines(numbered_lines(spark, path, pattern=PARTS), "score_1", 50)
    return flagged.select("subfolder", "file", "line_no", "selection")


@query
def file_selected_lines(spark, folder):
    """Source lines chosen by a file of flags, which are numbers or words."""
    flag = F.when(F.col("doc_id") % 6 == 0, "1").when(F.col("doc_id") % 6 == 1, "1.0").when(F.col("doc_id") % 6 == 2, "true")
    line = F.concat(F.lit('{"selection": '), flag.otherwise("0"), F.lit("}"))
    marks = table(spark, folder, "documents").select("doc_id", F.when(F.col("doc_id") % 6 == 5, "{}").otherwise(line).alias("line"))
    meta = corpus.read_records(spark, _written_corpus(spark, folder, marks, "meta"), True, PARTS)
    source = numbered_lines(spark, _written_corpus(spark, folder, _whole_lines(spark, folder), "source"), pattern=PARTS)
    chosen = selection.select_lines(source, meta)
    return chosen.select("subfolder", "file", "line_no", F.get_json_object("line", "$.content").alias("content"))


def written_clusters(spark, folder) -> str:
    """The folder that holds the clusters' documents as lines."""
    docs = tables.clusters(spark, folder)
    placed = running_total(docs.select("cluster", "doc_id"), "doc_id", groups=("cluster",), out="line_no")
    path = fresh(spark, "clusters")
    write_files(
        docs.drop("cluster").join(placed, "doc_id").select(
            F.concat(F.lit("clustering-"), F.col("cluster").cast("string")).alias("subfolder"),
            F.lit("rows").alias("file"),
            "line_no",
            F.to_json(F.struct("rank", "content")).alias("line"),
        ),
        "line",
        path,
    )
    return path


@query
def file_clusters(spark, folder):
    read = corpus.read_clusters(spark, written_clusters(spark, folder), 0, 99, PARTS)
    return clusters.sample_fixed(read, "tie").select("cluster", "rank", "content")


#: So many chunks of 512 tokens are kept in one file.
BUNDLE = 512


@query
def file_packed(spark, folder):
    """Word lengths as tokens, packed, written as tars of files, and read back."""
    lengths = tables.document_words(spark, folder).withColumn("tokens", F.transform("tokens", F.length))
    chunks = sequences.pack_tokens(lengths, "doc_id", "tokens", 512, F.lit(0))
    path = fresh(spark, "packed")
    packed.write_packed(chunks, path if ":/" in path else f"file://{path}", "train", packed.dtype_for(40_000), BUNDLE)
    return packed.read_packed(spark, path, "train").select("chunk_id", F.array_join("tokens", " ").alias("tokens"))


def _one_object(rows: DataFrame, part: Column, key: Column, value: Column, path: str) -> None:
    """Each part's (key, value) rows as one JSON object in one file."""
    objects = rows.groupBy(part.alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(key, value)))).alias("value"))
    objects.repartition("part").write.partitionBy("part").text(path)


@query
def file_bbh(spark, folder):
    path = fresh(spark, "bbh")
    items = table(spark, folder, "benchmark")
    _one_object(items, F.col("item_id"), F.concat(F.lit("task_"), F.col("item_id").cast("string")), F.col("text"), path)
    return evaluation.read_bbh(spark, path).select("task", "text")


@query
def file_tydiqa(spark, folder):
    """The first example of each language."""
    names = F.array(*[F.lit(name) for name in fixed.LANGUAGE_TEMPLATES])
    example = F.struct(
        "item_id",
        F.col("text").alias("context"),
        F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("question"),
        F.array(F.struct(F.element_at(text.words(F.col("text")), 1).alias("text"))).alias("answers"),
    )
    items = table(spark, folder, "benchmark").select(
        F.get(names, (F.col("item_id") % 9).cast("int")).alias("language"), example.alias("example")
    )
    # the least example of a language by item_id; no task or row holds more than one
    lists = items.groupBy("language").agg(F.array(F.min("example")).alias("examples"))
    path = fresh(spark, "tydiqa")
    _one_object(lists, F.col("language"), F.col("language"), F.col("examples"), path)
    return evaluation.read_tydiqa(spark, path)


def written_mmlu(spark, folder, split: str = "test") -> str:
    """The folder that holds a file of items for each subject."""
    w = text.words(F.col("text"))
    items = table(spark, folder, "benchmark").select(
        "item_id",
        F.concat(F.lit("subject_"), (F.col("item_id") % 3).cast("string"), F.lit(f"_{split}.csv")).alias("file"),
        F.col("text").alias("question"),
        *[F.element_at(w, i + 1).alias(c) for i, c in enumerate(evaluation.MMLU_LETTERS)],
        F.element_at(F.array(*[F.lit(c) for c in "ABCD"]), (F.col("item_id") % 4 + 1).cast("int")).alias("answer"),
    )
    path = fresh(spark, "mmlu")
    ordered = items.repartition("file").sortWithinPartitions("file", "item_id").drop("item_id")
    ordered.write.partitionBy("file").option("quoteAll", True).option("escape", '"').csv(path)
    return path


@query
def file_mmlu(spark, folder):
    """The first ten rows of each subject's file."""
    read = evaluation.read_mmlu(spark, written_mmlu(spark, folder), pattern=PARTS)
    return read.select("subject", "row_no", "question", F.array_join("options", "|").alias("options"), "answer")


@query
def file_weights(spark, folder):
    """Weights written as JSON files and read again."""
    path = fresh(spark, "weights")
    moved = weights.update_weights(tables.influences(spark, folder), weights.AgentWeights())
    save_weights(spark, moved, path, 1)
    read = load_weights(spark, path, 1)
    rows = [("collaboration", str(i), w) for i, w in enumerate(read.collaboration)]
    agents = spark.createDataFrame(rows, "family string, key string, weight double")
    return read.to_frame(spark).select("family", "key", "weight").unionByName(agents).withColumn("weight", r6("weight"))


@query
def predictions_written(spark, folder):
    """Predictions as lines: read back, with the report written beside them."""
    path = fresh(spark, "predictions")
    rows = metrics.with_predictions(tables.predictions(spark, folder))
    predictions.write_predictions(rows.withColumn("content", F.concat(F.lit("vector "), F.col("vec_id").cast("string"))), path)
    report = predictions.read_report(spark, path)
    count = predictions.read_predictions(spark, path).where(F.size("logits") == 64).groupBy(F.col("pred").cast("string").alias("name"))
    counts = count.agg(F.count("content").alias("predicted"))
    return report.join(counts, "name", "left").select(
        "place", "name", *[r6(c).alias(c) for c in ("precision", "recall", "f1", "support")], "predicted"
    )


@query
def losses_written(spark, folder):
    path = fresh(spark, "losses")
    words = F.size(text.words(F.col("text"))).cast("long")
    predictions.write_losses(
        table(spark, folder, "documents").select((F.col("n_chars") / 1000).alias("loss"), words.alias("num_tokens")), path
    )
    return predictions.read_loss_summary(spark, path).select("num_tokens", r6("loss").alias("loss"))


def _shares(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.posexplode("shares").alias("token", "share")).withColumn("share", r6("share"))


@query
def provider_rows(spark, folder):
    """A provider's answer for every document: its token shares."""
    rows = tables.document_words(spark, folder).withColumn("tokens", providers.token_bucket(F.col("tokens"), 64))
    return _shares(providers.apply_provider(rows.select("doc_id", "tokens"), "tokens", providers.TokenShares(64), "shares"))


@query
def interrupted_provider(spark, folder):
    """A provider that ran over some rows and then, again, over all: each row's influence, from its stored answer."""
    rows = tables.document_words(spark, folder).withColumn("tokens", providers.token_bucket(F.col("tokens"), 64))
    path, model = fresh(spark, "provider"), providers.TokenShares(64)
    providers.apply_and_store(rows.where("doc_id % 3 = 0"), "doc_id", "tokens", model, "shares", path)
    stored = providers.apply_and_store(rows, "doc_id", "tokens", model, "shares", path)
    scored = influence.first_step_loss_of_shares(stored, "doc_id", "shares", [1 / 64] * 64)
    return scored.select("doc_id", r6("influence").alias("influence"))


def _round(spark, folder) -> Round:
    return Round(
        influence=_written_influences(spark, folder),
        corpus=_written_corpus(spark, folder, _whole_lines(spark, folder), "corpus"),
        output=fresh(spark, "round"),
        top_n=table(spark, folder, "documents").count() // 10,
        pattern=PARTS,
    )


@query
def round_resumed(spark, folder):
    """A round whose first run ended before its scores were marked as whole: resumed, every processed line."""
    job = _round(spark, folder)
    weights_of = move_weights(spark, job)
    write_mark(spark, job.mark("weights"), job.constants())
    write_scores(spark, job, weights_of)
    resume_round(spark, job)
    lines = spark.read.option("recursiveFileLookup", True).text(published(spark, job)["processed"])
    value = F.from_json("value", "content string, score_1 double, selection int")
    return lines.select(value.alias("v")).select(
        F.col("v.content").alias("content"), r6("v.score_1").alias("score"), F.col("v.selection").alias("selection")
    )


@query
def round_over_files(spark, folder):
    """A whole iteration over files; the lines that it selects."""
    job = _round(spark, folder)
    run_round(spark, job)
    chosen = spark.read.option("recursiveFileLookup", True).text(job.folder("selected"))
    return chosen.select(F.get_json_object("value", "$.content").alias("content"))
