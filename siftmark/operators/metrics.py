"""Classifier evaluation from (label, pred, logits) rows.

Everything but top-k accuracy derives from the confusion table, which has at
most classes x classes rows and is the only thing ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.functions.vectors import argmax, rank_of, softmax
from siftmark.operators.ordering import sorted_positions

THRESHOLDS = (0.8, 0.6, 0.4, 0.2, 0.0)


def label_map(df: DataFrame, topic: str) -> DataFrame:
    """(topic, label): distinct topics numbered in sorted order.

    One numbering for the whole table; a numbering per batch would change
    meaning whenever a batch misses a class. Topics may be free text, as many as
    there are rows: they are ordered by ranges, not in one task.
    """
    classes = df.where(F.col(topic).isNotNull()).select(F.col(topic).alias("topic")).distinct()
    placed = sorted_positions(classes, [], [F.col("topic")], "label")
    return placed.select("topic", F.col("label").cast("int").alias("label"))


def with_predictions(df: DataFrame, logits: str = "logits") -> DataFrame:
    return df.withColumn("pred", argmax(F.col(logits)))


def probability_above(logits: Column, place: int, threshold: float) -> Column:
    """Whether the softmax probability at ``place`` exceeds ``threshold``."""
    return F.get(softmax(logits), F.lit(place)) > threshold


def confusion(df: DataFrame) -> DataFrame:
    return df.groupBy("label", "pred").agg(F.count("*").alias("n"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def per_class(cells: DataFrame) -> DataFrame:
    """(class, precision, recall, f1, support) over classes seen on either side."""
    sides = cells.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("label").alias("class"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("long").alias("predicted"),
                    F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("hits"),
                ),
                F.struct(
                    F.col("pred").alias("class"),
                    F.lit(0).cast("long").alias("support"),
                    F.col("n").alias("predicted"),
                    F.lit(0).cast("long").alias("hits"),
                ),
            )
        )
    )
    totals = sides.groupBy("class").agg(
        F.sum("support").alias("support"),
        F.sum("predicted").alias("predicted"),
        F.sum("hits").alias("hits"),
    )
    return totals.select(
        "class",
        _ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hits"), F.col("predicted") + F.col("support")).alias("f1"),
        "support",
    )


def _accuracy(cells: DataFrame) -> DataFrame:
    right = F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0))
    return cells.agg(_ratio(right, F.sum("n")).alias("accuracy"))


def macro_metrics(cells: DataFrame) -> DataFrame:
    """One row: accuracy and unweighted class means."""
    means = per_class(cells).agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1")
    )
    return means.withColumn("accuracy", _accuracy(cells).scalar())


def class_report(cells: DataFrame) -> DataFrame:
    """Class rows by falling support, then accuracy, macro and weighted means.

    The accuracy row carries its single number in every column. All come from
    one pass over the confusion cells: the classes, no more than these, are
    gathered in one row.
    """
    fields = ("precision", "recall", "f1")
    support = F.col("support").cast("double")
    one = per_class(cells).agg(
        F.array_sort(F.collect_list(F.struct(-support, "class", *fields, support.alias("support")))).alias("rows"),
        F.sum(support).alias("total"),
        _ratio(F.sum(F.col("recall") * support), F.sum(support)).alias("accuracy"),
        *[F.avg(c).alias(f"mean_{c}") for c in fields],
        *[_ratio(F.sum(F.col(c) * support), F.sum(support)).alias(f"weighted_{c}") for c in fields],
    )

    def row(place: Column, name: Column, values: list[Column], held: Column) -> Column:
        named = [v.cast("double").alias(c) for c, v in zip(fields, values)]
        return F.struct(place.cast("int").alias("place"), name.alias("name"), *named, held.alias("support"))

    body = F.transform(
        "rows", lambda x, i: row(i + 1, x["class"].cast("string"), [x[c] for c in fields], x["support"])
    )
    size, number = F.size("rows"), F.col("accuracy")
    tail = F.array(
        row(size + 1, F.lit("accuracy"), [number] * 3, number),
        row(size + 2, F.lit("macro avg"), [F.col(f"mean_{c}") for c in fields], F.col("total")),
        row(size + 3, F.lit("weighted avg"), [F.col(f"weighted_{c}") for c in fields], F.col("total")),
    )
    return one.select(F.inline(F.concat(body, tail)))


def precision_counts(report: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """(threshold, rows): report rows, summaries included, with a higher precision."""
    limits = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    above = report.select("precision", limits).groupBy("threshold")
    return above.agg(F.sum((F.col("precision") > F.col("threshold")).cast("long")).alias("rows"))


def top_k_accuracy(df: DataFrame, most: int = 5, logits: str = "logits") -> DataFrame:
    """(k, accuracy) for k = 1..most; equal logits favour the higher class."""
    ahead = df.select(rank_of(F.col(logits), F.col("label")).alias("ahead"))
    counts = ahead.agg(
        F.count("*").alias("n"),
        *[F.sum((F.col("ahead") < k).cast("long")).alias(f"k{k}") for k in range(1, most + 1)],
    )
    rows = [
        F.struct(F.lit(k).alias("k"), _ratio(F.col(f"k{k}"), F.col("n")).alias("accuracy"))
        for k in range(1, most + 1)
    ]
    return counts.select(F.inline(F.array(*rows)))


def mean_cross_entropy(losses: DataFrame, loss: str = "loss") -> DataFrame:
    """One row: the sum of position losses over the positions that count, at least one."""
    counted = F.greatest(F.count(loss), F.lit(1).cast("long"))
    return losses.agg((F.coalesce(F.sum(loss), F.lit(0.0)) / counted).alias("loss"))


def token_weighted_loss(batches: DataFrame) -> DataFrame:
    """(num_tokens, loss) from per-batch (loss, num_tokens)."""
    return batches.agg(
        F.sum("num_tokens").alias("num_tokens"),
        F.try_divide(F.sum(F.col("loss") * F.col("num_tokens")), F.sum("num_tokens")).alias("loss"),
    )
