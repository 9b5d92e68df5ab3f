"""Seeded random projection of long vectors in Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siftmark import fixed_values as fixed
from siftmark.functions.arrow_blocks import as_lists, as_matrix

ROW_BLOCK = 256
#: Signs come from the bits of MD5, so many from each digest.
DIGEST_BITS = 128
#: Results are handed on when they reach about so many bytes; a task remembers signs up to so many.
OUT_BYTES, SIGN_BYTES = 32_000_000, 64_000_000


def sign_block(seed: int, first: int, rows: int, width: int) -> np.ndarray:
    """Rows ``first`` to ``first + rows`` of the +1/-1 matrix.

    Column j of row i is bit j mod 4, from the least on, of hexadecimal digit
    j / 4 mod 32 of the MD5 of ``seed:i:block``, where block is j / 128. So any
    task can make any block alone, the whole matrix is never held or sent, and
    any engine with MD5 has the same signs.
    """
    blocks = -(-width // DIGEST_BITS)
    digests = b"".join(
        hashlib.md5(f"{seed}:{row}:{block}".encode()).digest()
        for row in range(first, first + rows)
        for block in range(blocks)
    )
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 1), axis=1, bitorder="little")
    by_digit = bits[:, [4, 5, 6, 7, 0, 1, 2, 3]].reshape(rows, -1)[:, :width]
    return by_digit.astype(np.float32) * 2 - 1


def project(block: np.ndarray, width: int, seed: int, signs=sign_block) -> np.ndarray:
    out = np.zeros((block.shape[0], width), dtype=np.float64)
    for first in range(0, block.shape[1], ROW_BLOCK):
        part = block[:, first : first + ROW_BLOCK]
        out += part @ signs(seed, first, part.shape[1], width)
    return out


def random_projection(
    df: DataFrame, vector: str, width: int = fixed.PROJECTION_DIM, seed: int = 0
) -> DataFrame:
    """Replace ``vector`` by its projection to ``width`` numbers.

    The signs are made from ``seed`` where they are used, once in a task while
    they fit in its memory; inner products are kept up to the factor ``width``,
    as with any sign projection.
    """

    names = df.columns
    schema = T.StructType(
        [
            T.StructField(vector, T.ArrayType(T.DoubleType())) if f.name == vector else f
            for f in df.schema.fields
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = max(1, SIGN_BYTES // (4 * ROW_BLOCK * width))
        signs = lru_cache(maxsize=kept)(sign_block)
        rows = max(1, OUT_BYTES // (8 * width))
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                out = as_lists(project(as_matrix(batch.column(vector)), width, seed, signs))
                columns = [out if n == vector else batch.column(n) for n in names]
                yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(run, schema)
