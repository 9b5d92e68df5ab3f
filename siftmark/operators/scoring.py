"""Document scores from category weights, with epoch decay."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark import fixed_values as fixed
from siftmark.operators.weights import AgentWeights

KEEP = "kept"


def decay(epoch: Column, rate: float = fixed.DECAY_LAMBDA) -> Column:
    """``1 / (1 + rate * epoch)``; null where the divisor is zero."""
    return F.try_divide(F.lit(1.0), F.lit(1.0) + F.lit(rate) * epoch)


def _constant_map(weights: dict[str, float], prefix: str = "") -> Column:
    """The weights as one map constant, folded when the query is planned."""
    entries = {key.removeprefix(prefix): float(weight) for key, weight in weights.items()}
    return F.from_json(F.lit(json.dumps(entries)), "map<string,double>")


def _pick(column: str, weights: dict[str, float], prefix: str = "") -> Column:
    return F.try_element_at(_constant_map(weights, prefix), F.col(column))


def quality_bounds(key: str) -> tuple[float, float]:
    """Bounds of a ``quality_lo_hi`` key."""
    _, low, high = key.split("_")[:3]
    return float(low), float(high)


def _first_bucket(edu: str, values: dict[str, str], otherwise: str) -> Column:
    """The SQL ``values`` entry of the first bucket with ``lo <= edu < hi``."""
    if not values:
        return F.expr(otherwise)
    bounds = {key: quality_bounds(key) for key in values}
    cases = [
        f"WHEN {edu} >= {bounds[key][0]!r}D AND {edu} < {bounds[key][1]!r}D THEN {value}"
        for key, value in values.items()
    ]
    return F.expr(f"CASE {' '.join(cases)} ELSE {otherwise} END")


def quality_value(edu: str, weights: dict[str, float]) -> Column:
    """Weight of the first matching bucket; 0 outside all."""
    return _first_bucket(edu, {k: f"{float(w)!r}D" for k, w in weights.items()}, "0.0D")


def quality_bucket(edu: str, weights: dict[str, float]) -> Column:
    """Key of the bucket that :func:`quality_value` uses, or null."""
    return _first_bucket(edu, {k: f"'{k}'" for k in weights}, "CAST(NULL AS STRING)")


def drop_reason(weights: AgentWeights) -> Column:
    """Why a record gets no score, or ``kept``.

    A bad educational score only matters while there are quality buckets.
    """
    topics = [k.removeprefix("topic_") for k in weights.topic]
    bad_edu = F.col("edu").isNull() if weights.quality else F.lit(False)
    unknown_domain = F.col("domain").isNull() | ~F.col("domain").isin(list(weights.domain))
    unknown_topic = F.col("topic").isNull() | ~F.col("topic").isin(topics)
    return (
        F.when(bad_edu, "bad_quality")
        .when(unknown_domain, "unknown_domain")
        .when(unknown_topic, "unknown_topic")
        .when(F.col("epoch").isNull(), "bad_epoch")
        .when(F.lit(1.0) + F.lit(fixed.DECAY_LAMBDA) * F.col("epoch") == 0, "zero_divisor")
        .otherwise(KEEP)
    )


def scorable(weights: AgentWeights) -> Column:
    """Records that get a score, as plain conditions a scan can evaluate."""
    topics = [k.removeprefix("topic_") for k in weights.topic]
    kept = (
        F.col("domain").isin(list(weights.domain))
        & F.col("topic").isin(topics)
        & F.col("epoch").isNotNull()
        & (F.lit(1.0) + F.lit(fixed.DECAY_LAMBDA) * F.col("epoch") != 0)
    )
    return kept & F.col("edu").isNotNull() if weights.quality else kept


def score_column(weights: AgentWeights) -> Column:
    """The decayed mix of quality, domain and topic weight of a scorable record."""
    alpha, beta, gamma = weights.collaboration
    mixed = (
        F.lit(alpha) * quality_value("edu", weights.quality)
        + F.lit(beta) * _pick("domain", weights.domain)
        + F.lit(gamma) * _pick("topic", weights.topic, "topic_")
    )
    return mixed * decay(F.col("epoch"))


def score_records(records: DataFrame, weights: AgentWeights, iteration: int = 1) -> DataFrame:
    """Add ``score_{iteration}`` and drop the records that cannot have one.

    ``records`` has ``domain``, ``topic`` (as text), ``edu`` and ``epoch``. The
    weights enter the plan as constants, so the lookups are expressions inside
    one generated stage: no join and no shuffle.
    """
    return records.where(scorable(weights)).withColumn(f"score_{iteration}", score_column(weights))
