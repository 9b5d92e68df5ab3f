"""Repeated byte strings through prefix-free parsing.

Rolling-hash triggers cut documents into phrases. The dictionary has each
distinct phrase once; the parse is every document's sequence of phrases. Phrases
overlap by one byte less than a window, so each window lies in one phrase, and
no phrase is needed to tell a window from one of another trigger. What the parse
repeats whole is repeated; in the rest, windows of one trigger are compared by
ranks of 4, 8, 16, ... bytes, cut off at a window's length, or, for many phrases,
by counts of window hashes, exact up to clashes of 128 bits. This stands in for
the suffix arrays of dictionary and parse, which are not made, nor is the
corpus order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from siftmark.llm import repeats

#: A 64-bit number for each byte.
TABLE = repeats.mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(repeats.BASE))


def byte_hashes():
    return lambda parts: TABLE[np.frombuffer(b"".join(parts), np.uint8)]


BYTES = repeats.Symbols(split=bytes, hashes=byte_hashes, join=bytes)


def ranks_of_four(codes: np.ndarray) -> np.ndarray:
    """Names of every four consecutive symbols below 512, in their order."""
    codes = np.concatenate([codes, np.zeros(3, np.int64)])
    joined = codes[:-3] << 27 | codes[1:-2] << 18 | codes[2:-1] << 9 | codes[3:]
    return np.unique(joined, return_inverse=True)[1].astype(np.int64)


def solver(width: int):
    def solve(phrases: list[bytes]) -> list[np.ndarray]:
        """For each phrase the starts of windows that another phrase has too."""
        lengths = np.array([len(p) + 1 for p in phrases])
        offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        codes = np.frombuffer(b"\0".join(phrases) + b"\0", np.uint8).astype(np.int64) + 1
        codes[offsets + lengths - 1] = 0
        counts = np.maximum(lengths - width, 0)
        starts = np.repeat(offsets - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        shared = repeats.deepest(ranks_of_four(codes), 4, width, starts)
        return [np.flatnonzero(x) for x in np.split(shared, np.cumsum(counts)[:-1])]

    return solve


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 200, gram: int = 32, large: int = repeats.LARGE
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept, kept_sha256): ``kept`` are the bytes of
    the UTF-8 text outside all repeated strings of ``width`` bytes.

    A string is repeated if it also starts anywhere else, in the same document
    too, judged on the input. ``kept`` may cut characters and is binary. Null,
    empty and shorter texts lose nothing. Rows that are equal repeat each other;
    rows that share an id but not the text are documents of their own, also with
    a null id. Other columns are ignored; an empty table gives none.
    """
    runs = repeats.Runs(width, gram)
    named = repeats.keyed(docs, id_col, text)
    found = repeats.flagged(named, repeats.packed(named), runs, BYTES, solver(width), large)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            made = []
            for packed, own in zip(batch.column(1), batch.column(2)):
                content = press.decompress(packed.as_py())
                gone = repeats.covered(len(content), own.as_py(), runs)
                kept = np.frombuffer(content, np.uint8)[~gone].tobytes()
                spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                made.append((len(content), int(gone.sum()), spans, kept, hashlib.sha256(kept).hexdigest()))
            columns = [pa.array(list(c), k) for c, k in zip(zip(*made) if made else [()] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
    key = named.schema["_id"].dataType.simpleString()
    return found.select("_id", "_packed", "_runs").mapInArrow(
        run, f"`{id_col}` {key}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    )
