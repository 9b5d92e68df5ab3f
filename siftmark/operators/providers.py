"""Where a model plugs in: it sees Arrow batches and returns plain columns.

Spark partitions the rows and retries tasks; a provider is loaded once per
Python worker and must give the same answer for the same row each time.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from types import ModuleType
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Provider(Protocol):
    """A model: ``open`` loads it in the worker, ``rows`` answers a batch of tokens."""

    def open(self) -> None: ...

    def rows(self, tokens: pd.Series) -> list[np.ndarray]: ...


def opened(key: str, provider: Provider) -> Provider:
    """The copy of ``provider`` that this worker has opened under ``key``.

    A worker runs many tasks and each brings a copy of its own; the first is
    opened and kept, until a task with another key comes.
    """
    held = sys.modules.setdefault("siftmark_opened", ModuleType("siftmark_opened"))
    if getattr(held, "key", None) != key:
        provider.open()
        held.key, held.model = key, provider
    return held.model


def apply_provider(df: DataFrame, tokens: str, provider: Provider, out: str) -> DataFrame:
    """Add ``out``, an array of doubles per row, and drop the tokens.

    All other columns pass through Arrow as well, so select an id before. Used with ``out`` = influence (validation losses after one step on the
    row), gradient or representation. A row keeps its own result whatever the
    partitioning, so nothing has to be lined up by position afterwards.
    """
    kept = [f for f in df.schema.fields if f.name != tokens]
    schema = T.StructType([*kept, T.StructField(out, T.ArrayType(T.DoubleType()))])

    key = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = opened(key, provider)
        for batch in batches:
            answers = model.rows(batch[tokens])
            yield batch.drop(columns=[tokens]).assign(**{out: answers})

    return df.mapInPandas(run, schema)


def apply_and_store(
    df: DataFrame, id_col: str, tokens: str, provider: Provider, out: str, path: str
) -> DataFrame:
    """Answers for all rows, kept as parquet under ``path``.

    Rows already answered there by an earlier, interrupted run are left out,
    so a rerun only pays for the rest.
    """
    spark = df.sparkSession
    schema = T.StructType([df.schema[id_col], T.StructField(out, T.ArrayType(T.DoubleType()))])
    # an empty append makes the folder exist before it is read
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    done = spark.read.schema(schema).parquet(path).select(id_col)
    rest = df.select(id_col, tokens).join(done, id_col, "left_anti")
    apply_provider(rest, tokens, provider, out).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def token_frequencies(tokens: pd.Series, vocabulary: int) -> np.ndarray:
    """One row of relative token frequencies per sequence; zeros for an empty or null one."""
    block = np.zeros((len(tokens), vocabulary))
    for i, ids in enumerate(tokens):
        if ids is not None and len(ids):
            block[i] = np.bincount(np.asarray(ids, dtype=np.int64), minlength=vocabulary) / len(ids)
    return block


@dataclass
class TokenShares:
    """Relative frequencies of a row's token ids below ``vocabulary``."""

    vocabulary: int

    def open(self) -> None:
        pass

    def rows(self, tokens: pd.Series) -> list[np.ndarray]:
        return list(token_frequencies(tokens, self.vocabulary))


def token_bucket(tokens, vocabulary: int):
    """Token ids for words: MD5 into ``vocabulary`` buckets, the same in any engine."""
    return F.transform(
        tokens, lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % vocabulary).cast("int")
    )
