"""Every operator as a named query over the stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftmark import fixed_values as fixed
from siftmark.functions import schedule, text, vectors
from siftmark.functions.chance import uniform
from siftmark.operators import (
    annotation,
    classifier,
    clusters,
    influence,
    matching,
    metrics,
    projection,
    prompts,
    providers,
    sampling,
    scoring,
    selection,
    sequences,
    threshold,
    weights,
)
from siftmark.operators.ordering import running_total
from siftmark.plans import gradient_scores, tables, topic_labels
from siftmark.plans.tables import table
from siftmark.session import materialize
from siftmark.sources.corpus import parse_records

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def r6(column) -> Column:
    """Rounded to six places, without a negative zero."""
    return F.round(column, 6) + F.lit(0.0)


def ladder() -> weights.AgentWeights:
    """Distinct fixed weights: (i + 1) / sum in key order."""

    def steps(keys):
        total = len(keys) * (len(keys) + 1) / 2
        return {k: (i + 1) / total for i, k in enumerate(keys)}

    return weights.AgentWeights(
        quality=steps(fixed.QUALITY_KEYS), domain=steps(fixed.DOMAIN_KEYS), topic=steps(fixed.TOPIC_KEYS)
    )


# ------------------------------------------------------------------- scoring
@query
def score_documents(spark, folder):
    scored = scoring.score_records(tables.records(spark, folder), ladder())
    return scored.select("doc_id", "domain", r6("score_1").alias("score"))


@query
def score_epoch_decay(spark, folder):
    return tables.records(spark, folder).select("doc_id", "epoch", r6(scoring.decay(F.col("epoch"))).alias("decay"))


@query
def score_drop_rules(spark, folder):
    parsed = parse_records(tables.raw_lines(spark, folder))
    reason = scoring.drop_reason(ladder())
    score = F.when(F.col("reason") == scoring.KEEP, r6(scoring.score_column(ladder())))
    return parsed.withColumn("reason", reason).select("doc_id", "reason", score.alias("score"))


@query
def quality_bucket_lookup(spark, folder):
    return tables.records(spark, folder).select(
        "doc_id",
        "edu",
        scoring.quality_bucket("edu", ladder().quality).alias("bucket"),
        r6(scoring.quality_value("edu", ladder().quality)).alias("quality"),
    )


# ------------------------------------------------------------------- weights
@query
def influence_flatten(spark, folder):
    losses = weights.flatten_influence(tables.influences(spark, folder))
    return losses.select("family", "key", "position", r6("loss").alias("loss"))


@query
def influence_stats(spark, folder):
    stats = weights.influence_stats(weights.flatten_influence(tables.influences(spark, folder)))
    return stats.select("family", "key", "n", F.round("mean_loss", 10).alias("mean_loss"), F.round("std_loss", 10).alias("std_loss"))


def _folded(spark, folder):
    return weights.fold_losses(tables.influences(spark, folder), weights.AgentWeights())


@query
def ewma_weights(spark, folder):
    return _folded(spark, folder).select("family", "key", "n", r6("weight").alias("weight"))


@query
def normalized_weights(spark, folder):
    shares = weights.normalize_families(_folded(spark, folder))
    return shares.select("family", "key", r6("weight").alias("weight"))


def _s_values(spark, folder):
    return weights.s_values(weights.normalize_families(_folded(spark, folder)))


@query
def s_values(spark, folder):
    return _s_values(spark, folder).select("family", "key", r6(F.col("s") * 1000).alias("s_thousandths"))


@query
def collaborative_weights(spark, folder):
    moved = weights.collaborate(_s_values(spark, folder), weights.AgentWeights().collaboration)
    return moved.select("agent", r6("weight").alias("weight"))


@query
def second_iteration(spark, folder):
    lines = tables.influences(spark, folder)
    first = weights.update_weights(lines, weights.AgentWeights())
    shares = weights.s_values(weights.normalize_families(weights.fold_losses(lines, first)))
    moved = weights.collaborate(shares, first.collaboration)
    return shares.select("family", "key", r6("weight").alias("weight")).unionByName(
        moved.select(
            F.lit("collaboration").alias("family"), F.col("agent").cast("string").alias("key"), r6("weight").alias("weight")
        )
    )


# ----------------------------------------------------------------- selection
def _scored(spark, folder):
    moved = weights.update_weights(tables.influences(spark, folder), weights.AgentWeights())
    return scoring.score_records(tables.records(spark, folder), moved)


def _tenth(spark, folder):
    return table(spark, folder, "documents").count() // 10


@query
def full_iteration(spark, folder):
    flagged = threshold.flag_top_n(_scored(spark, folder), "score_1", _tenth(spark, folder))
    return flagged.select("doc_id", r6("score_1").alias("score"), "selection")


@query
def topn_threshold(spark, folder):
    scored = _scored(spark, folder)
    limit = threshold.top_n_threshold(scored, "score_1", _tenth(spark, folder))
    return scored.where(threshold.flag_from(F.col("score_1"), limit) == 1).agg(
        r6(F.lit(limit)).alias("threshold"), F.count("*").alias("selected")
    )


@query
def selection_flag(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return threshold.flag_top_n(orders, "o_totalprice", orders.count() // 20).select("o_orderkey", "selection")


@query
def topn_zero(spark, folder):
    """No row is flagged when none is wanted."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return threshold.flag_top_n(orders, "o_totalprice", 0).select("o_orderkey", "selection")


@query
def select_lines(spark, folder):
    # scores and places are stored once, narrow: each has several readers
    scored = materialize(_scored(spark, folder).select("doc_id", "score_1"), "scores")
    flagged = threshold.flag_top_n(scored, "score_1", _tenth(spark, folder))
    places = materialize(tables.source_lines(spark, folder).drop("line"), "places")
    documents = table(spark, folder, "documents").select("doc_id", F.col("text").alias("line"))
    source = places.join(documents, "doc_id")
    meta = places.join(flagged.select("doc_id", "selection"), "doc_id")
    return selection.select_lines(source, meta).select("subfolder", "file", "line_no", "line")


@query
def top_percent(spark, folder):
    best = threshold.select_top_share(_scored(spark, folder), "score_1", 5)
    return best.select("doc_id", r6("score_1").alias("score"))


# ------------------------------------------------------------------ clusters
@query
def cluster_sample_10(spark, folder):
    return clusters.sample_fixed(tables.clusters(spark, folder), "doc_id").select("cluster", "rank", "content", "doc_id")


@query
def cluster_sample_by_size(spark, folder):
    return clusters.sample_by_size(tables.clusters(spark, folder), "doc_id", 20).select(
        "cluster", "rank", "content", "doc_id"
    )


@query
def cluster_sample_by_size_events(spark, folder):
    return clusters.sample_by_size(tables.event_clusters(spark, folder), "event_id").select(
        "cluster", "rank", "content", "event_id"
    )


@query
def cluster_windows(spark, folder):
    start = clusters.cluster_window(F.col("doc_id"))
    return table(spark, folder, "documents").groupBy(start.alias("window_start")).agg(F.count("*").alias("rows"))


@query
def batch_requests(spark, folder):
    docs = table(spark, folder, "documents").select(
        "doc_id", tables.source_number().alias("cluster"), F.col("n_chars").alias("rank"), F.col("text").alias("content")
    )
    schema = (
        "custom_id string, method string, url string, body struct<model: string, temperature: double, "
        "response_format: struct<type: string>, messages: array<struct<role: string, content: string>>>"
    )
    read = annotation.build_requests(docs).select("doc_id", F.from_json("request", schema).alias("r"))
    message = F.col("r.body.messages")
    return read.select(
        "doc_id",
        "r.custom_id",
        "r.method",
        "r.url",
        F.col("r.body.model").alias("model"),
        F.col("r.body.temperature").cast("string").alias("temperature"),
        F.col("r.body.response_format.type").alias("format"),
        message[0]["role"].alias("first_role"),
        message[0]["content"].alias("prompt"),
        message[1]["role"].alias("second_role"),
        message[1]["content"].alias("content"),
    )


@query
def parse_responses(spark, folder):
    return annotation.parse_responses(tables.responses(spark, folder))


@query
def labelled_examples(spark, folder):
    """Documents with the topic that their answer names; some answers name another one."""
    docs = tables.clusters(spark, folder).where("content IS NOT NULL")
    topic = F.when(F.col("doc_id") % 29 == 0, "Gardening").otherwise(
        F.get(F.array(*[F.lit(t) for t in fixed.TOPIC_NAMES]), (F.col("doc_id") % 13).cast("int"))
    )
    answer = F.to_json(F.struct(F.col("lang").alias("topic"), topic.alias("selected topic")))
    choices = F.array(F.struct(F.struct(answer.alias("content")).alias("message")))
    response = F.struct(
        F.get_json_object("request", "$.custom_id").alias("custom_id"),
        F.struct(F.struct(choices.alias("choices")).alias("body")).alias("response"),
    )
    asked = annotation.build_requests(docs, tie="doc_id").join(
        table(spark, folder, "documents").select("doc_id", "lang"), "doc_id"
    )
    answered = asked.where(F.col("doc_id") % 11 != 0).select(F.to_json(response).alias("response"))
    found = topic_labels.labelled_examples(docs, annotation.parse_responses(answered, keep_id=True), "doc_id")
    return found.select("doc_id", "cluster", "topic", "label", "known")


# ------------------------------------------------------------------- metrics
def _predicted(spark, folder):
    return metrics.with_predictions(tables.predictions(spark, folder))


def _cells(spark, folder):
    return metrics.confusion(_predicted(spark, folder))


@query
def label_map(spark, folder):
    named = table(spark, folder, "documents").select(
        F.get(F.array(*[F.lit(t) for t in fixed.TOPIC_NAMES]), (F.col("doc_id") % 13).cast("int")).alias("name")
    )
    return metrics.label_map(named, "name")


@query
def argmax_pred(spark, folder):
    return _predicted(spark, folder).select("vec_id", "label", "pred")


@query
def confusion_matrix(spark, folder):
    return _cells(spark, folder)


@query
def class_report(spark, folder):
    report = metrics.class_report(_cells(spark, folder))
    return report.select("place", "name", *[r6(c).alias(c) for c in ("precision", "recall", "f1", "support")])


@query
def macro_metrics(spark, folder):
    row = metrics.macro_metrics(_cells(spark, folder))
    return row.select(*[r6(c).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query
def precision_threshold_counts(spark, folder):
    return metrics.precision_counts(metrics.class_report(_cells(spark, folder)))


@query
def topk_accuracy(spark, folder):
    return metrics.top_k_accuracy(tables.predictions(spark, folder)).select("k", r6("accuracy").alias("accuracy"))


@query
def class_weights(spark, folder):
    labels = table(spark, folder, "embeddings").select("label")
    return classifier.class_weights(labels).select("label", r6("weight").alias("weight"))


@query
def softmax_threshold(spark, folder):
    logits = F.col("logits")
    return tables.predictions(spark, folder).select(
        "vec_id",
        r6(F.get(vectors.softmax(logits), F.lit(1))).alias("probability"),
        metrics.probability_above(logits, 1, 0.1).alias("above"),
    )


@query
def cross_entropy(spark, folder):
    loss = vectors.cross_entropy(F.col("logits"), F.col("label"), ignore=9)
    return tables.predictions(spark, folder).select("vec_id", r6(loss).alias("loss"))


@query
def cross_entropy_mean(spark, folder):
    losses = tables.predictions(spark, folder).select(
        vectors.cross_entropy(F.col("logits"), F.col("label"), ignore=9).alias("loss")
    )
    return metrics.mean_cross_entropy(losses).select(r6("loss").alias("loss"))


@query
def sample_next(spark, folder):
    kept = vectors.softmax_kept(vectors.crop_to_top(F.col("logits"), 3), 0.8)
    drawn = vectors.draw_from(kept, uniform(5, F.col("vec_id")))
    return tables.predictions(spark, folder).select("vec_id", drawn.alias("next"))


def _batches(spark, folder):
    return table(spark, folder, "documents").select(
        (F.col("n_chars") / 1000).alias("loss"), F.size(text.words(F.col("text"))).alias("num_tokens")
    )


@query
def token_weighted_loss(spark, folder):
    return metrics.token_weighted_loss(_batches(spark, folder)).select("num_tokens", r6("loss").alias("loss"))


@query
def mean_validation_loss(spark, folder):
    return _batches(spark, folder).agg(r6(F.avg("loss")).alias("loss"))


# ------------------------------------------------------------------ matching
def _elements(df: DataFrame, column: str) -> DataFrame:
    return df.select("vec_id", F.posexplode(column).alias("pos", "value")).withColumn("value", r6("value"))


@query
def l2_normalize(spark, folder):
    scaled = table(spark, folder, "embeddings").select(
        "vec_id",
        F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") + 1)).alias("v"),
    )
    return _elements(matching.normalize_rows(scaled, "v"), "v")


@query
def sign_gradient(spark, folder):
    signed = vectors.sign_gradient(F.col("embedding")).alias("v")
    return _elements(table(spark, folder, "embeddings").select("vec_id", signed), "v")


@query
def adam_gradient(spark, folder):
    gradient = vectors.doubles(F.col("embedding"))
    squared = F.transform(F.concat(F.slice(gradient, 33, 32), F.slice(gradient, 1, 32)), lambda x: x * x)
    direction = vectors.adam_gradient(gradient, F.reverse(gradient), squared).alias("v")
    return _elements(table(spark, folder, "embeddings").select("vec_id", direction), "v")


@query
def match_influence(spark, folder):
    rows = table(spark, folder, "embeddings").select(
        F.lit(0).alias("ckpt"), "vec_id", "label", F.col("embedding").alias("vector")
    )
    validation = rows.where(F.col("label") == 0).withColumn("position", F.lit(0))
    train = rows.where(F.col("label") != 0).withColumnRenamed("vec_id", "train_id")
    return matching.match_influence(train, validation, 1).select("train_id", r6("score").alias("score"))


@query
def match_multi_ckpt(spark, folder):
    rows = tables.gradients(spark, folder)
    validation = rows.where(F.col("vec_id") < 54).withColumn("position", F.col("vec_id"))
    train = rows.where(F.col("vec_id") >= 54).withColumnRenamed("vec_id", "train_id")
    scores = matching.match_influence(train, validation, fixed.SUBTASKS["bbh"], {0: 2.0, 1: 3.0})
    return scores.select("train_id", r6("score").alias("score"))


@query
def ckpt_renormalize(spark, folder):
    counts = table(spark, folder, "embeddings").groupBy(F.col("label").alias("ckpt")).agg(F.count("*").alias("w"))
    rows = counts.collect()  # one number per checkpoint
    shares = matching.renormalize([float(r.w) for r in rows])
    weighed = spark.createDataFrame([(r.ckpt, w) for r, w in zip(rows, shares)], "ckpt int, weight double")
    return weighed.select(F.col("ckpt").cast(counts.schema["ckpt"].dataType).alias("ckpt"), r6("weight").alias("weight"))


@query
def match_incomplete(spark, folder):
    """Every fifth training row lacks a checkpoint and is marked by a null score."""
    rows = tables.gradients(spark, folder)
    validation = rows.where(F.col("vec_id") < 54).withColumn("position", F.col("vec_id"))
    train = rows.where((F.col("ckpt") == 0) | (F.col("vec_id") % 5 != 0)).withColumnRenamed("vec_id", "train_id")
    scores = matching.match_influence(train, validation, 9, {0: 1.0, 1: 1.0})
    return scores.select("train_id", r6("score").alias("score"))


# --------------------------------------------------------------------- texts
@query
def qa_join(spark, folder):
    joined = text.join_question_answer(F.col("question"), F.col("answer"), "</s>")
    return tables.question_pairs(spark, folder).select("conv_id", "turn", joined.alias("text"))


@query
def qa_encode(spark, folder):
    """Question and answer joined, ended, tokenized and masked."""
    masked = prompts.encode_pairs(
        tables.question_pairs(spark, folder), text.words, " </s>", fixed.SEQUENCE_LENGTH, F.lit(str(fixed.IGNORE_INDEX))
    )
    return masked.select(
        "conv_id",
        "turn",
        F.array_join("input_ids", " ").alias("input_ids"),
        F.array_join("labels", " ").alias("labels"),
        F.size("attention_mask").alias("attended"),
    )


@query
def pad_with_mask(spark, folder):
    """Ids padded with 0 and labels with the ignored value, to whole rows with a mask."""
    chunks = sequences.overlap_chunks(tables.document_words(spark, folder), "tokens", 256)
    padded = text.padded_rows(chunks.withColumn("labels", F.col("input_ids")), 256, F.lit("0"), F.lit("-1"))
    return padded.select(
        "doc_id",
        "chunk_no",
        *[F.array_join(c, " ").alias(c) for c in ("input_ids", "labels")],
        F.array_join(F.transform("attention_mask", lambda x: x.cast("string")), "").alias("attention_mask"),
    )


@query
def last_token_state(spark, folder):
    """The value of the last token that is not padding."""
    rows = table(spark, folder, "embeddings").select(
        "vec_id",
        F.transform("embedding", lambda x: F.array(x.cast("double"), -x.cast("double"))).alias("states"),
        F.transform("embedding", lambda x, i: (i <= F.col("vec_id") % 64).cast("int")).alias("mask"),
    )
    state = vectors.last_state(F.col("states"), F.col("mask"))
    return rows.select("vec_id", r6(F.get(state, F.lit(0))).alias("first"), r6(F.get(state, F.lit(1))).alias("second"))


@query
def prompt_mask(spark, folder):
    pairs = tables.question_pairs(spark, folder).select(
        "conv_id", "turn", F.col("question").alias("prompt"), F.concat(F.lit(" "), "answer").alias("completion")
    )
    ignored = F.lit(str(fixed.IGNORE_INDEX))
    masked = prompts.tokenize_prompts(pairs, text.words, fixed.SEQUENCE_LENGTH, ignored)
    return masked.select(
        "conv_id",
        "turn",
        F.array_join("input_ids", " ").alias("input_ids"),
        F.array_join("labels", " ").alias("labels"),
        F.size(F.filter("labels", lambda x: x != ignored)).alias("counted"),
    )


@query
def pad_truncate(spark, folder):
    padded = text.pad_or_cut(F.col("tokens"), fixed.SEQUENCE_LENGTH, F.lit("0"))
    return tables.document_words(spark, folder).select("doc_id", F.array_join(padded, " ").alias("input_ids"))


@query
def chunk_overlap(spark, folder):
    chunks = sequences.overlap_chunks(tables.document_words(spark, folder), "tokens", 512)
    return chunks.select("doc_id", "chunk_no", "start", F.array_join("input_ids", " ").alias("input_ids"))


@query
def chunk_stopped(spark, folder):
    """Windows that stop once 1,024 tokens are reached."""
    chunks = sequences.overlap_chunks(
        tables.document_words(spark, folder), "tokens", 512, fixed.SEQUENCE_LENGTH
    )
    return chunks.select("doc_id", "chunk_no", "start", F.array_join("input_ids", " ").alias("input_ids"))


@query
def chunk_all(spark, folder):
    """How often windows of 100 tokens hold each document's tokens: no token is missing."""
    chunks = sequences.overlap_chunks(tables.document_words(spark, folder), "tokens", 100)
    held = chunks.groupBy("doc_id").agg(F.sum(F.size("input_ids")).alias("held"), F.max(F.col("start") + F.size("input_ids")).alias("tokens"))
    return held.select("doc_id", "tokens", "held")


@query
def chunk_whole(spark, folder):
    chunks = sequences.overlap_chunks(tables.document_words(spark, folder), "tokens")
    return chunks.select("doc_id", F.array_join("input_ids", " ").alias("input_ids"), F.size("input_ids").alias("n"))


def _blocks(spark, folder):
    chunks = sequences.pack_tokens(tables.document_words(spark, folder), "doc_id", "tokens", 512, F.lit("<pad>"))
    return sequences.blocks_of(chunks, 512, 64)


@query
def pack_blocks(spark, folder):
    return _blocks(spark, folder).select("chunk_id", "block_id", F.array_join("tokens", " ").alias("tokens"))


@query
def block_permutation(spark, folder):
    return sampling.permute_blocks(_blocks(spark, folder), 2, 8, 12345).select("chunk_id", "block_id", "read_order")


@query
def block_permutation_wrap(spark, folder):
    """With an unfilled last window filled from the beginning."""
    order = sampling.permute_blocks(_blocks(spark, folder), 4, 8, 12345, wrap=True)
    return order.select("chunk_id", "block_id", "read_order")


def _event_positions(spark, folder):
    return running_total(table(spark, folder, "events").select("event_id"), "event_id")


@query
def slice_counted(spark, folder):
    return _event_positions(spark, folder).select("event_id", sampling.counted_slice(F.col("position")).alias("slice"))


@query
def slice_plain(spark, folder):
    return _event_positions(spark, folder).select("event_id", sampling.plain_slice(F.col("position")).alias("slice"))


@query
def shard_files(spark, folder):
    pages = table(spark, folder, "pages").select("page_id")
    total = pages.agg(F.count("*"))
    placed = running_total(pages, "page_id").withColumn("n", total.scalar())
    return placed.select("page_id", sampling.shard_of(F.col("position"), F.col("n"), 3, 2).alias("shard"))


# ------------------------------------------------------------------ sampling
@query
def random_sample(spark, folder):
    return sampling.random_share(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", 0.25, 7)


@query
def validation_rows(spark, folder):
    return sampling.shuffle_and_take(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", 11)


@query
def train_valid_split(spark, folder):
    return sampling.split_by_draw(table(spark, folder, "documents").select("doc_id"), "doc_id", 0.9, 3)


@query
def weighted_mixture(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "lang")
    shares = {"en": 0.4, "fr": 0.3, "de": 0.2, "es": 0.1}
    return sampling.mix_sources(rows, "doc_id", "lang", shares, 12345).select("draw", "lang", "doc_id")


@query
def cycle_epochs(spark, folder):
    return sampling.repeat_epochs(table(spark, folder, "documents").select("doc_id"), 3)


# ------------------------------------------------------------------ formulas
@query
def wsd_lr(spark, folder):
    rate = schedule.wsd_lr(F.col("event_id") * 41)
    return table(spark, folder, "events").select("event_id", r6(rate * 1000000).alias("lr_millionths"))


@query
def flops_estimate(spark, folder):
    cost = schedule.step_flops(F.col("n_chars"), 24, 2048, 1_300_000_000)
    return table(spark, folder, "documents").select("doc_id", r6(cost / 1e12).alias("teraflops"))


@query
def round_up(spark, folder):
    return table(spark, folder, "documents").select("doc_id", schedule.round_up(F.col("n_chars"), 64).alias("padded"))


# ----------------------------------------------------------------- templates
def _doc_items(spark, folder):
    doc = F.col("doc_id")
    options = [F.col("source"), F.col("lang"), F.concat("source", "lang"), F.lit("none")]
    return table(spark, folder, "documents").select(
        "doc_id",
        *[F.col("text").alias(c) for c in ("passage", "context", "article")],
        F.concat(F.lit("Which source has document "), doc.cast("string"), F.lit("?")).alias("question"),
        "source",
        F.array(*options).alias("options"),
        *[o.alias(f"answer{c}") for o, c in zip(options, "ABC")],
    )


def _prompted(items: DataFrame, task: str, ident: str) -> DataFrame:
    return prompts.build_prompts(items, task).select(ident, "prompt", "completion")


@query
def template_boolq(spark, folder):
    items = _doc_items(spark, folder).withColumn("answer", F.col("doc_id") % 2 == 0)
    return _prompted(items, "boolq", "doc_id")


@query
def template_squad(spark, folder):
    items = _doc_items(spark, folder).withColumn("answers", F.struct(F.array("source").alias("text")))
    return _prompted(items, "squad", "doc_id")


@query
def template_race(spark, folder):
    items = _doc_items(spark, folder).withColumn("answer", prompts.letter(F.col("doc_id") % 4, 65))
    return _prompted(items, "race", "doc_id")


@query
def template_social_iqa(spark, folder):
    items = _doc_items(spark, folder).withColumn("label", (F.col("doc_id") % 3 + 1).cast("string"))
    return _prompted(items, "social_iqa", "doc_id")


def _word(i: int) -> Column:
    return F.coalesce(F.get("w", F.lit(i)), F.lit("-"))


def _word_items(spark, folder):
    item = F.col("item_id")
    four = F.array(*[_word(i) for i in range(4)])
    return tables.item_words(spark, folder).select(
        "item_id",
        "text",
        "w",
        *[F.col("text").alias(c) for c in ("question", "question_stem", "sentence", "ctx", "context", "support")],
        F.struct(F.array(*[F.lit(c) for c in "ABCD"]).alias("label"), four.alias("text")).alias("choices"),
        four.alias("endings"),
        four.alias("options"),
        prompts.letter(item % 4, 65).alias("answerKey"),
    )


@query
def template_arc_easy(spark, folder):
    return _prompted(_word_items(spark, folder), "arc_easy", "item_id")


@query
def template_arc_challenge(spark, folder):
    return _prompted(_word_items(spark, folder), "arc_challenge", "item_id")


@query
def template_commonsense_qa(spark, folder):
    return _prompted(_word_items(spark, folder), "commonsense_qa", "item_id")


@query
def template_openbookqa(spark, folder):
    return _prompted(_word_items(spark, folder), "openbookqa", "item_id")


@query
def template_sciq(spark, folder):
    names = ("distractor1", "distractor2", "distractor3", "correct_answer")
    items = _word_items(spark, folder).select("*", *[_word(i).alias(c) for i, c in enumerate(names)])
    return _prompted(items, "sciq", "item_id")


@query
def template_winogrande(spark, folder):
    items = _word_items(spark, folder).select(
        "*", _word(0).alias("option1"), _word(1).alias("option2"), (F.col("item_id") % 2 + 1).cast("string").alias("answer")
    )
    return _prompted(items, "winogrande", "item_id")


@query
def template_hellaswag(spark, folder):
    items = _word_items(spark, folder).withColumn("label", (F.col("item_id") % 4).cast("string"))
    return _prompted(items, "hellaswag", "item_id")


@query
def template_lambada(spark, folder):
    items = _word_items(spark, folder).select(
        "item_id",
        F.array_join(F.slice("w", 1, F.size("w") - 1), " ").alias("until_last"),
        F.element_at("w", -1).alias("last_word"),
    )
    return _prompted(items, "lambada", "item_id")


@query
def template_jeopardy(spark, folder):
    items = _word_items(spark, folder).withColumn("continuation", F.get("w", F.lit(0)))
    return _prompted(items, "jeopardy", "item_id")


@query
def template_mmlu(spark, folder):
    items = _word_items(spark, folder).select(
        "*",
        F.concat(F.lit("high_school_"), (F.col("item_id") % 5).cast("string")).alias("subject"),
        F.col("answerKey").alias("answer"),
    )
    return _prompted(items, "mmlu", "item_id")


@query
def template_tydiqa(spark, folder):
    languages = F.array(*[F.lit(name) for name in fixed.LANGUAGE_TEMPLATES])
    items = _doc_items(spark, folder).select(
        "doc_id",
        "context",
        "question",
        F.col("source").alias("answer"),
        F.get(languages, (F.col("doc_id") % 9).cast("int")).alias("language"),
    )
    return _prompted(items, "tydiqa", "doc_id")


@query
def template_tydiqa_zh(spark, folder):
    items = _doc_items(spark, folder).select("doc_id", "context", "question", F.col("source").alias("answer"), F.lit("english").alias("language"))
    return prompts.build_prompts(items, "tydiqa", chinese=True).select("doc_id", "prompt", "completion")


@query
def template_bbh(spark, folder):
    examples = [F.concat(F.lit("Q: "), _word(i), F.lit("\nA: "), _word(i + 3)) for i in range(3)]
    items = _word_items(spark, folder).select(
        "item_id", F.concat_ws("\n\n", F.col("text"), *examples).alias("text")
    )
    return prompts.build_prompts(items, "bbh").select("item_id", "example_no", "prompt", "completion")


@query
def template_chat_styles(spark, folder):
    items = _word_items(spark, folder).withColumn("continuation", F.get("w", F.lit(0)))
    styled = [
        prompts.build_prompts(items, "jeopardy", style).select("item_id", F.lit(style).alias("style"), "prompt")
        for style in (prompts.INST, prompts.RAW)
    ]
    return styled[0].unionByName(styled[1])


@query
def bbh_styles(spark, folder):
    """The three-example task in the two styles without roles."""
    examples = [F.concat(F.lit("Q: "), _word(i), F.lit("\nA: "), _word(i + 3)) for i in range(3)]
    items = _word_items(spark, folder).select("item_id", F.concat_ws("\n\n", F.col("text"), *examples).alias("text"))
    styled = [
        prompts.build_prompts(items, "bbh", style).select("item_id", "example_no", F.lit(style).alias("style"), "prompt", "completion")
        for style in (prompts.INST, prompts.RAW)
    ]
    return styled[0].unionByName(styled[1])


@query
def squad_rows(spark, folder):
    """The first 501 items, of which 500 shuffled ones are kept and encoded."""
    items = _doc_items(spark, folder).withColumn("answers", F.struct(F.array("source").alias("text")))
    items = running_total(items.select("doc_id"), "doc_id", out="item_no").join(items, "doc_id")
    kept = gradient_scores.evaluation_set(items, "squad", text.words, ignore=F.lit("-"))
    return kept.select("doc_id", "item_no", F.array_join("input_ids", " ").alias("input_ids"), F.array_join("labels", " ").alias("labels"))


# -------------------------------------------- models (checked by row and test)
@query
def random_projection(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return _elements(projection.random_projection(rows, "embedding", 16), "embedding")


VOCABULARY = 64


def _bucketed(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("tokens", providers.token_bucket(F.col("tokens"), VOCABULARY))


@query
def unigram_influence(spark, folder):
    """Influence of every document on the benchmark's token mix, in columns."""
    held_out = _bucketed(tables.item_words(spark, folder).select(F.col("w").alias("tokens")))
    counts = held_out.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    shares = counts.select("token", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))  # 64 rows
    rows = _bucketed(tables.document_words(spark, folder))
    scored = influence.first_step_loss(rows, "doc_id", "tokens", shares, VOCABULARY)
    return scored.select("doc_id", r6("influence").alias("influence"))


@query
def gradient_matching(spark, folder):
    """Vectors, projected and normalized, matched against those of one label."""
    rows = table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    projected = materialize(gradient_scores.project_and_normalize(rows, 32), "gradients")
    good = projected.where("label = 0")
    validation = good.select(F.lit(0).alias("ckpt"), F.lit(0).alias("position"), "vector")
    train = projected.select(F.lit(0).alias("ckpt"), F.col("vec_id").alias("train_id"), "vector")
    return matching.match_influence(train, validation, 1).select("train_id", r6("score").alias("score"))


@query
def project_and_normalize(spark, folder):
    """All values of all vectors, projected to more than one digest's signs, at length one."""
    rows = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return _elements(gradient_scores.project_and_normalize(rows, 160, 3), "vector")


@query
def mllib_topic_classifier(spark, folder):
    labelled = (
        table(spark, folder, "documents")
        .join(table(spark, folder, "labels"), "doc_id")
        .select("doc_id", F.col("text").alias("content"), F.col("quality").alias("label"))
    )
    model = classifier.train_classifier(labelled, weighted=True)
    documents = table(spark, folder, "documents").select("doc_id", F.col("text").alias("content"))
    return classifier.predict(model, documents).select("doc_id", "pred")
