"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.llm.common import text_bytes
from siftmark.llm.ftrl import Ftrl, bounded_sample, sigmoid, sparse
from siftmark.session import materialize

#: Features are hashed to so many bits; feature 0 is the constant.
BITS = 20
#: Labelled rows to learn from at most, and how often they are gone through.
SAMPLE, EPOCHS = 16_000, 4
#: A toxic row counts as much as so many others; there are few of them.
TOXIC_WEIGHT = 2.0
REMEMBERED = 400_000
WORDS = re.compile(r"\w+")
#: Odd factors that tell the places of a pair apart.
PAIR = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
SKIP = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class Hasher:
    """Distinct hashed words, pairs of neighbours, and pairs with one word between them."""

    def __init__(self, bits: int = BITS):
        self.shift, self.known = np.uint64(64 - bits), {}

    def __call__(self, content: bytes) -> np.ndarray:
        words = WORDS.findall(content.decode().lower())
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        for word in words:
            if word not in known:
                known[word] = crc32(word.encode()) + 1
        codes = np.array([known[w] for w in words], np.uint64)
        found = [codes * PAIR[0], codes[:-1] * PAIR[0] + codes[1:] * PAIR[1], codes[:-2] * SKIP[0] + codes[2:] * SKIP[1]]
        hashes = np.concatenate(found)
        hashes ^= hashes >> np.uint64(29)
        return (hashes * PAIR[1] >> self.shift).astype(np.int32)


def distinct(features: np.ndarray) -> np.ndarray:
    """The constant and each feature once."""
    return np.unique(np.append(features, 0))


def fit(rows: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) that are not 0, learned from labelled ``rows`` of a bounded number.

    Documents become feature lists where they are read; one task goes through
    the lists, in a fixed order.
    """

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(bits)
        for batch in batches:
            made = [distinct(hasher(x)) for x in text_bytes(batch.column(2))]
            columns = [batch.column(0).cast(pa.string()), batch.column(1).cast(pa.int32()), pa.array(made, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "features"])

    def learn(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        model = Ftrl(1 << bits)
        order = sorted(range(len(frame)), key=lambda i: (crc32(frame["id"][i].encode()), frame["id"][i]))
        for _ in range(EPOCHS):
            for i in order:
                model.learn(frame["features"][i], float(frame["label"][i]), TOXIC_WEIGHT if frame["label"][i] else 1.0)
        at, weights = sparse(model.weights())
        return pd.DataFrame({"at": [at], "weights": [weights]})

    narrow = rows.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(label), F.col(text))
    table = narrow.mapInArrow(lists, "id string, label int, features array<int>")
    found = table.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(learn, "at array<int>, weights array<float>").first()
    if found is None:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    return np.array(found.at, np.int32), np.array(found.weights, np.float32)


def scores(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """(id, score): the probability of label 1 of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 ** bits weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weights = shared.value
        dense = np.zeros(1 << bits, np.float32)
        dense[at] = weights
        hasher = Hasher(bits)
        for batch in batches:
            sums = []
            for content in text_bytes(batch.column(1)):
                found = hasher(content)
                found = distinct(found[dense[found] != 0])
                sums.append(float(dense[found].sum(dtype=np.float64)))
            made = pa.array(sigmoid(np.array(sums)), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=[id_col, "score"])

    named = docs.select(F.col(id_col), F.col(text))
    key = named.schema[0].dataType.simpleString()
    return named.mapInArrow(run, f"`{id_col}` {key}, score double")


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE
) -> DataFrame:
    """(id, held_out, score, predicted) of every document.

    Learns from at most ``sample`` labelled rows outside the held-out fifth
    (crc32 of the id as text, mod 5, is 0), a fixed pseudo-random choice; text
    alone enters. Of several labels of an id the highest counts; null labels and
    ids do not. Null and empty texts get the score of the constant. Without any
    label to learn from every score is 0.5. Rows that repeat an id get a row
    each. Other columns are ignored; an empty table gives none.
    """
    outside = F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0
    marks = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & outside)
    marks = marks.groupBy(id_col).agg(F.max(label).alias(label))
    chosen = materialize(bounded_sample(marks, id_col, sample, 5), "sampled-labels")
    # `chosen` has at most `sample` narrow rows
    rows = docs.select(id_col, text).join(F.broadcast(chosen), id_col)
    scored = scores(docs, fit(rows, id_col, text, label), id_col, text)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select(
        id_col, held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
