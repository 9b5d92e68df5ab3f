"""Joins against small sides whose size is checked before they are broadcast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def join_checked(
    large: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Join narrow ``small``, broadcast only when it has at most ``rows`` rows.

    Beyond that both sides are shuffled on the key as usual.
    """
    if small.limit(rows + 1).count() <= rows:
        small = F.broadcast(small)
    return large.join(small, list(on), how)
