"""Exact global top-N cut-off without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 65536
LARGEST = 1.7976931348623157e308


# A cell number that never falls as ``score`` rises: 32 cells per power of two,
# so the whole double range has under 140,000 of them. Infinities have their own.
LOG_CELL = (
    f"CASE WHEN abs(score) > {LARGEST!r}D THEN sign(score) * 200000 "
    "ELSE sign(score) * (floor(log2(abs(score)) * 32) + 40000) END"
)


def _linear_cell(low: float, high: float) -> str:
    return f"floor((score - {low!r}D) / {high - low!r}D * {CELLS})"


def _narrow(scores: DataFrame, cell: str, need: int):
    """Bounds of the cell holding the ``need``-th row from the top.

    Rows are counted per cell on the map side, so each task shuffles at most
    one row per cell, and one task walks the cells.
    """
    cells = scores.groupBy(F.expr(f"CAST(coalesce({cell}, 0) AS BIGINT)").alias("cell")).agg(
        F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")
    )
    walked = cells.selectExpr("*", "sum(n) OVER (ORDER BY cell DESC) AS seen")
    return walked.selectExpr(
        f"max_by(struct(low, high, {need} - seen + n AS need), cell) FILTER (WHERE seen >= {need}) AS found",
        "min(low) AS smallest",
    ).head()


def top_n_threshold(df: DataFrame, score: str, n: int) -> float | None:
    """The N-th largest score, or the smallest when there are fewer rows.

    Each pass counts rows per cell of the score axis and keeps the cell that
    holds the N-th row; it stops once that cell has a single score, however
    many rows tie on it. The first pass uses logarithmic cells, later ones cut
    the kept cell 65,536-fold, so two or three narrow scans of the score
    column are usual. Only one row of bounds per pass reaches the driver.
    Null and NaN scores are never selected; no rows, or an ``n`` below one,
    give ``None``, which no score reaches.
    """
    found = top_n_place(df, score, n)
    return found and found[0]


def top_n_place(df: DataFrame, score: str, n: int) -> tuple[float, int] | None:
    """The threshold of :func:`top_n_threshold`, and how many of the rows that tie on it
    belong to the best ``n``."""
    if n < 1:
        return None
    value = F.col(score)
    scores = df.select(F.col(score).cast("double").alias("score")).where(
        value.isNotNull() & ~F.isnan(value)
    )
    row = _narrow(scores, LOG_CELL, n)
    if row.found is None:  # fewer rows: all of them, ties on the last one included
        return None if row.smallest is None else (row.smallest, n)
    found = row.found
    while found.low < found.high:
        inside = scores.where(value.between(found.low, found.high))
        found = _narrow(inside, _linear_cell(found.low, found.high), found.need).found
    return found.low, found.need


def flag_from(score: Column, threshold: float | None) -> Column:
    """1 where the score reaches the threshold, else 0; a null score gives 0."""
    if threshold is None:
        return F.lit(0)
    reaches = score.cast("double") >= F.lit(threshold)
    return F.when(reaches & ~F.isnan(score.cast("double")), 1).otherwise(0)


def reaching(df: DataFrame, score: str, threshold: float | None) -> DataFrame:
    """Rows whose score reaches the threshold, as a condition a scan can skip by."""
    if threshold is None:
        return df.where(F.lit(False))
    return df.where((F.col(score) >= F.lit(threshold)) & ~F.isnan(score))


def flag_top_n(df: DataFrame, score: str, n: int, out: str = "selection") -> DataFrame:
    """Add ``out`` = 1 where the score reaches the top-N threshold, else 0.

    Rows tied with the threshold are all kept, so more than ``n`` may be.
    """
    return df.withColumn(out, flag_from(F.col(score), top_n_threshold(df, score, n)))


def select_top_share(df: DataFrame, score: str, percent: float) -> DataFrame:
    """Rows whose score reaches the best ``percent`` of all scored rows."""
    value = F.col(score).cast("double")
    total = df.where(value.isNotNull() & ~F.isnan(value)).count()
    n = int(total * percent / 100.0)
    if n == 0:
        return df.where(F.lit(False))
    return reaching(df, score, top_n_threshold(df, score, n))
