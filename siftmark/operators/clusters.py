"""Evenly spaced samples of each cluster's documents by rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark import fixed_values as fixed
from siftmark.operators.joins import join_checked
from siftmark.operators.ordering import sorted_positions


def _sample(docs: DataFrame, tie: str, keep: Column) -> DataFrame:
    narrow = docs.select("cluster", "rank", tie)
    order = [F.col("rank").asc_nulls_last(), F.col(tie)]
    placed = sorted_positions(narrow, ["cluster"], order, count="cluster_rows")
    chosen = placed.where(keep).select("cluster", tie, "position")
    return join_checked(docs, chosen, ["cluster", tie]).where(F.col("content").isNotNull())


def sample_fixed(docs: DataFrame, tie: str, size: int = fixed.CLUSTER_SAMPLE_SIZE) -> DataFrame:
    """Up to ``size`` documents per cluster, every ``ceil(n / size)``-th by rank.

    ``docs`` has (cluster, rank, content) and a unique ``tie``. Missing ranks
    come last; documents without content go after sampling. Only the narrow
    sort keys are ordered, and a cluster may span any number of tasks.
    """
    step = F.ceil(F.col("cluster_rows") / size)
    return _sample(docs, tie, F.col("position") % step == 0)


def sample_by_size(
    docs: DataFrame, tie: str, rows_per_sample: int = fixed.CLUSTER_ROWS_PER_SAMPLE
) -> DataFrame:
    """``ceil(n / rows_per_sample)`` evenly spaced documents per cluster by rank."""
    wanted = F.greatest(F.ceil(F.col("cluster_rows") / rows_per_sample), F.lit(1))
    step = F.greatest(F.floor(F.col("cluster_rows") / wanted), F.lit(1))
    spaced = (F.col("position") % step == 0) & (F.floor(F.col("position") / step) < wanted)
    return _sample(docs, tie, spaced)


def cluster_window(cluster: Column, width: int = fixed.CLUSTER_WINDOW) -> Column:
    """Start of the window of clusters a request file covers."""
    return F.floor(cluster / width) * width
