"""Repeated word strings among windows that meet by their least gram.

Windows are dealt to groups by the least hash of their grams of some words,
anywhere in the window; groups that this leaves too large are dealt by a hash of
the whole window. Inside a group, places get names at depths of 1, 2, 4, ...
words, up to the width of a window, and a name that no other place has is dropped
as soon as it appears; equal names at the full depth are the starts of a repeat.
This stands in for prefix-partitioned suffix trees: no nodes and no maximal
repeats are made. Groups of one phrase, however often it occurs, need no names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from siftmark.llm import repeats

REMEMBERED = 400_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def word_hashes():
    known = _Hashes()

    def hashes(parts: list[list[bytes]]) -> np.ndarray:
        if len(known) > REMEMBERED:
            known.clear()
        return np.fromiter((known[w] for part in parts for w in part), np.uint64)

    return hashes


WORDS = repeats.Symbols(split=bytes.split, hashes=word_hashes, join=b" ".join)


def solver(width: int):
    def solve(phrases: list[bytes]) -> list[np.ndarray]:
        """For each phrase the starts of windows that another phrase has too."""
        codes: dict[bytes, int] = defaultdict(count(1).__next__)
        lists = [p.split() for p in phrases]
        lengths = np.array([len(x) + 1 for x in lists])
        names = np.fromiter((c for x in lists for c in (*map(codes.__getitem__, x), 0)), np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        counts = np.maximum(lengths - width, 0)
        starts = np.repeat(offsets - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        shared = repeats.deepest(names, 1, width, starts)
        return [np.flatnonzero(x) for x in np.split(shared, np.cumsum(counts)[:-1])]

    return solve


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 35, gram: int = 10, large: int = repeats.LARGE
) -> DataFrame:
    """(id, n_words, n_removed, kept, kept_sha256): ``kept`` are the words outside all
    repeated windows of ``width`` words, joined by a space.

    A window is repeated if its words also start anywhere else, in the same
    document too, judged on the input. Null, empty and shorter texts lose
    nothing. Rows that are equal repeat each other; rows that share an id but not
    the text are documents of their own, also with a null id. Other columns are
    ignored; an empty table gives none.
    """
    runs = repeats.Runs(width, gram)
    named = repeats.keyed(docs, id_col, text)
    found = repeats.flagged(named, repeats.packed(named), runs, WORDS, solver(width), large)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            made = []
            for content, own in zip(batch.column(1), batch.column(2)):
                words = press.decompress(content.as_py()).split()
                gone = repeats.covered(len(words), own.as_py(), runs)
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                made.append((len(words), int(gone.sum()), kept, hashlib.sha256(kept).hexdigest()))
            columns = [pa.array(list(c), k) for c, k in zip(zip(*made) if made else [()] * 4, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    names = [id_col, "n_words", "n_removed", "kept", "kept_sha256"]
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string())
    key = named.schema["_id"].dataType.simpleString()
    out = found.select("_id", "_packed", "_runs").mapInArrow(
        run, f"`{id_col}` {key}, n_words long, n_removed long, kept binary, kept_sha256 string"
    )
    return out.withColumn("kept", out["kept"].cast("string"))
