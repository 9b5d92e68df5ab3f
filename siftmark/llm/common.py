"""What the operators of this folder share: words, Arrow columns, joins that may be skewed."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space: what separates words, and what normalised text leaves out.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 of every text, one at a time, null as empty. ``bytes.split()`` and
    ``bytes.lower()`` know ASCII only, so they give exactly the words of ``WORD``."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def plain_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words, without making the words."""
    squeezed = F.regexp_replace(text, WORD, "x")
    return F.length(F.regexp_replace(squeezed, SPACE, "")).cast("long")


def growing(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is sorted and never broadcast. For tables that
    grow with the input: Spark takes an exploded table for as small as the one below
    it, and a stored one for as small as its files, and would send it by the driver."""
    return df.hint("merge")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt evenly before each row becomes many: adaptive execution leaves few
    tasks of a small table. By a hash of the key's own, as dealing by a column again
    would be left out of the plan."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, F.xxhash64(key))


def join_spread(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on ``keys`` in which few keys may hold most rows of ``left``.

    The keys' hash is a further join key. So neither side keeps the partitioning
    of an aggregation below it, both are dealt by the join itself, and adaptive
    execution can split hot partitions of ``left``. Null keys match nothing.
    """
    spread = F.xxhash64(*keys)
    return left.withColumn("_spread", spread).join(
        right.withColumn("_spread", spread), [*keys, "_spread"], how
    ).drop("_spread")


def bucket_count(rows: int, each: int) -> int:
    """A power of two: so many buckets that a bucket holds about ``each`` rows."""
    return 1 << max(0, (rows // each).bit_length())
