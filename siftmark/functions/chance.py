"""Seeded chance as a column: the same on every run, partitioning and retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) fixed by ``seed`` and ``keys``, from 52 bits of MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def choose(draw: Column, weights: list[float]) -> Column:
    """Index of the weight in whose share of [0, 1) ``draw`` falls."""
    total = float(sum(weights))
    chosen = F.lit(len(weights) - 1)
    bound = 1.0
    for i in range(len(weights) - 1, 0, -1):
        bound = sum(weights[:i]) / total
        chosen = F.when(draw < F.lit(bound), F.lit(i - 1)).otherwise(chosen)
    return chosen
