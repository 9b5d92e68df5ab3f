"""Two tokenizers' tokens of the same bytes, aligned, and their links counted over the corpus.

Texts are aligned in slabs: all texts' tokens end to end, for both sides end where a
text does, merged in pieces of equal work however long the texts are. A slab is
stored as one row, with the different pairs of linked ids it has and, for each
text, where its pairs stand among these. So what is shuffled to count pairs is a
row for each pair and slab, not for each link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from siftmark.llm.byte_bpe import Coder
from siftmark.llm.merge_path import overlaps
from siftmark.session import materialize

#: Texts are tokenized and merged together up to about so many characters, and stored up to so many.
TOKENIZED, SLAB = 500_000, 8_000_000
#: Ends merged in a piece.
WORK = 65_536
SPACE_SIGN = "▁"


class Aligned(NamedTuple):
    """Tokens of several texts and their overlaps. ``a_counts`` and ``b_counts`` are tokens
    by text; ``links_a`` and ``links_b`` number the tokens of all texts; the tokens
    ``group_a`` and ``group_b`` are the last ones of each group."""

    a: np.ndarray
    b: np.ndarray
    a_counts: np.ndarray
    b_counts: np.ndarray
    links_a: np.ndarray
    links_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray


class Aligner:
    """Tokenizer A is a byte-level BPE file, B a SentencePiece model with byte pieces."""

    def __init__(self, a_json: str, b_model: bytes):
        self.coder = Coder(a_json, with_marks=False)
        self.pieces = SentencePieceProcessor(model_proto=b_model)
        merges = self.coder.merges
        self.a_bytes = [merges.token_bytes.get(i, b"") for i in range(max(merges.token_bytes) + 1)]
        self.b_bytes = [self._piece_bytes(i) for i in range(self.pieces.get_piece_size())]
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        most = max(len(self.a_bytes), len(self.b_bytes))
        self.signs = [f"{i}{sign}" for i in range(most) for sign in ",|;"]

    def _piece_bytes(self, piece: int) -> bytes:
        name = self.pieces.id_to_piece(piece)
        return bytes([int(name[3:5], 16)]) if self.pieces.is_byte(piece) else name.replace(SPACE_SIGN, " ").encode()

    def align(self, texts: list[str]) -> Aligned:
        """Texts that are empty, or whose tokens' bytes are not a space and the text, have no tokens."""
        a_ids: list[list[int]] = [[] for _ in texts]
        b_ids: list[list[int]] = [[] for _ in texts]
        some = [k for k, text in enumerate(texts) if text]
        coded = self.coder.encoded([" " + texts[k] for k in some])
        for k, own_a, own_b in zip(some, coded, self.pieces.encode([texts[k] for k in some], num_threads=1)):
            content, ids = (" " + texts[k]).encode(), np.frombuffer(own_a, "<u4").tolist()
            if b"".join(map(self.a_bytes.__getitem__, ids)) == content == b"".join(map(self.b_bytes.__getitem__, own_b)):
                a_ids[k], b_ids[k] = ids, own_b
        a, b = (np.array([i for own in ids for i in own], np.int64) for ids in (a_ids, b_ids))
        merged = overlaps(np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b]), WORK)
        counts = (np.array([len(own) for own in ids], np.int64) for ids in (a_ids, b_ids))
        return Aligned(a, b, *counts, merged.a, merged.b, merged.a[merged.shared], merged.b[merged.shared])

    def group_texts(self, found: Aligned) -> list[str]:
        """For each text its groups as ``a1,a2|b1;a3|b2,b3``."""
        a_at, b_at = np.arange(len(found.a)), np.arange(len(found.b))
        a_group, b_group = np.searchsorted(found.group_a, a_at), np.searchsorted(found.group_b, b_at)
        signs = np.empty(len(a_at) + len(b_at), np.int64)
        signs[a_at + np.append(0, found.group_b + 1)[a_group]] = found.a * 3 + (found.group_a[a_group] == a_at)
        signs[b_at + found.group_a[b_group] + 1] = found.b * 3 + 2 * (found.group_b[b_group] == b_at)
        ends = np.cumsum(found.a_counts + found.b_counts)
        starts = ends - found.a_counts - found.b_counts
        name = self.signs.__getitem__
        return ["".join(map(name, signs[s:e].tolist()))[:-1] for s, e in zip(starts.tolist(), ends.tolist())]


def _kept(holder: dict) -> Aligner:
    if "aligner" not in holder:
        holder["aligner"] = Aligner(holder["a"], holder["b"])
    return holder["aligner"]


def _slabs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, list[str]]]:
    """(ids, texts) of about ``most`` characters at a time."""
    for batch in batches:
        first, texts, size = 0, [], 0
        for row, value in enumerate(batch.column(1)):
            texts.append(value.as_py() or "")
            size += len(texts[-1])
            if size > most or row + 1 == len(batch):
                yield batch.column(0).slice(first, len(texts)), texts
                first, texts, size = row + 1, [], 0


def _of_text(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)


def aligned(docs: DataFrame, a_json: str, b_model: bytes, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, a_ids, b_ids, groups): both tokenizers' ids of every text, of a space and the
    text, and the groups that they fall into: (n_a, n_b) ids in order.

    Null and empty texts have none, nor have texts that either tokenizer changes. Strings of
    special tokens are plain text. Rows that repeat an id get a row each; a null id is
    kept; other columns are ignored; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast({"a": a_json, "b": b_model})  # the size of two vocabularies
    pairs = pa.list_(pa.struct([("n_a", pa.int32()), ("n_b", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _slabs(batches, TOKENIZED):
            found = _kept(shared.value).align(texts)
            parts = [np.split(x, np.cumsum(n)[:-1]) for x, n in ((found.a, found.a_counts), (found.b, found.b_counts))]
            sizes = [np.diff(x, prepend=-1) for x in (found.group_a, found.group_b)]
            groups = np.bincount(_of_text(found.a_counts)[found.group_a], minlength=len(texts))
            cut = np.cumsum(groups)[:-1]
            lists = [
                [{"n_a": x, "n_b": y} for x, y in zip(own_a.tolist(), own_b.tolist())]
                for own_a, own_b in zip(*(np.split(s, cut) for s in sizes))
            ]
            columns = [ids, *(pa.array(p, pa.list_(pa.int32())) for p in parts), pa.array(lists, pairs)]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "a_ids", "b_ids", "groups"])

    named = docs.select(F.col(id_col), F.col(text).cast("string"))
    kind = named.schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, a_ids array<int>, b_ids array<int>, groups array<struct<n_a: int, n_b: int>>"
    return named.mapInArrow(run, schema)


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _stored_slabs(docs: DataFrame, a_json: str, b_model: bytes) -> DataFrame:
    """A row for each slab: (slab, ids, n_a, n_b, n_groups, n_links, groups_sha256, pairs,
    texts, starts, places, times). Pair ``pairs[i]`` is in ``texts[i]`` of the slab's texts;
    a text's pairs, at ``places[starts[t]:starts[t + 1]]`` of ``pairs``, are linked ``times``."""
    shared = docs.sparkSession.sparkContext.broadcast({"a": a_json, "b": b_model})
    named = docs.select("doc_id", F.col("text").cast("string"))
    id_kind = named.schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, links, size, made = [], [], [], 0, 0
        for own_ids, texts in _slabs(batches, TOKENIZED):
            aligner = _kept(shared.value)
            found = aligner.align(texts)
            text_of_a = _of_text(found.a_counts)
            shas = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in aligner.group_texts(found)]
            text_of_link = text_of_a[found.links_a]
            counts = [np.bincount(x, minlength=len(texts)) for x in (text_of_a[found.group_a], text_of_link)]
            code = found.a[found.links_a] * len(aligner.b_bytes) + found.b[found.links_b]
            shift = (len(aligner.a_bytes) * len(aligner.b_bytes)).bit_length()
            keys, times = np.unique(text_of_link << shift | code, return_counts=True)
            ids.append(own_ids)
            rows.append((found.a_counts, found.b_counts, *counts, shas))
            links.append((keys & (1 << shift) - 1, times, np.bincount(keys >> shift, minlength=len(texts))))
            size += sum(map(len, texts))
            if size > SLAB:
                yield slab(ids, rows, links, made)
                ids, rows, links, size, made = [], [], [], 0, made + 1
        if ids:
            yield slab(ids, rows, links, made)

    def slab(ids: list, rows: list, links: list, number: int) -> pa.RecordBatch:
        codes, times, numbers = (np.concatenate(x) for x in zip(*links))
        pairs, places, texts = np.unique(codes, return_inverse=True, return_counts=True)
        shas = [sha for row in rows for sha in row[-1]]
        lists = [pa.concat_arrays(ids), *(np.concatenate(x) for x in zip(*(row[:-1] for row in rows))), shas, pairs, texts]
        lists.append(np.append(0, np.cumsum(numbers)))
        blobs = [np.diff(places, prepend=0).astype("<i4").tobytes(), times.astype("<i4").tobytes()]
        key = (TaskContext.get().partitionId() << 32) + number
        columns = [pa.array([key])]
        columns += [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in lists]
        columns += [pa.array([x], pa.binary()) for x in blobs]
        return pa.RecordBatch.from_arrays(columns, names=names)

    names = ["slab", "ids", *_COUNTS, "groups_sha256", "pairs", "texts", "starts", "places", "times"]
    kinds = ["long", f"array<{id_kind.simpleString()}>", *["array<long>"] * 4, "array<string>", *["array<long>"] * 3, "binary", "binary"]
    slabs = named.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
    return materialize(slabs, "slabs")


def link_statistics(docs: DataFrame, a_json: str, b_model: bytes) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row per document.

    A link is a pair of an A and a B token whose bytes overlap; the count of a pair of ids
    is how many documents have it linked. ``n_best`` are links of whose A id no pair counts
    more; ``count_sum`` sums the links' counts. A document without tokens, as in
    ``aligned``, has zeros and an empty digest. Rows that repeat an id are documents of
    their own; a null id is kept; other columns are ignored; an empty table gives none.
    """
    b_size = SentencePieceProcessor(model_proto=b_model).get_piece_size()
    slabs = _stored_slabs(docs, a_json, b_model)
    held = slabs.select("slab", F.posexplode(F.arrays_zip("pairs", "texts")).alias("place", "_held")).select(
        "slab", "place", F.col("_held.pairs").alias("pair"), F.col("_held.texts").alias("texts")
    )
    counts = materialize(held.groupBy("pair").agg(F.sum("texts").alias("n")), "pairs")
    a = F.floor(F.col("pair") / b_size)
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # at most a row for each A id
    marked = counts.withColumn("a", a).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    known = held.select(F.col("slab").alias("of"), "place", "pair").join(marked, "pair").select("of", "place", "n", "best")

    def summed(slab: pa.Table, pairs: pa.Table) -> pa.Table:
        def values(name: str) -> pa.Array:
            return slab.column(name).combine_chunks().flatten()

        starts = values("starts").to_numpy()
        n, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        order = pairs.column("place").to_numpy()
        n[order], best[order] = pairs.column("n").to_numpy(), pairs.column("best").to_numpy()
        places = np.cumsum(np.frombuffer(slab.column("places")[0].as_py(), "<i4"), dtype=np.int64)
        times = np.frombuffer(slab.column("times")[0].as_py(), "<i4").astype(np.int64)
        sums = [np.append(0, np.cumsum(times * x[places])) for x in (best, n)]
        columns = [values("ids"), *map(values, _COUNTS), *(s[starts[1:]] - s[starts[:-1]] for s in sums), values("groups_sha256")]
        return pa.table([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    names = ["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256"]
    kinds = [docs.schema["doc_id"].dataType.simpleString(), *["long"] * 6, "string"]
    rest = slabs.drop("pairs", "texts")
    return rest.groupBy("slab").cogroup(known.groupBy("of")).applyInArrow(
        summed, ", ".join(f"{n} {k}" for n, k in zip(names, kinds))
    )
