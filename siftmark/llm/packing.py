"""Best-fit decreasing packing of token pieces into sequences.

Lengths are whole numbers up to the capacity, so pieces of one length are alike
and best fit needs only their counts: a table of at most ``capacity`` rows,
however many pieces there are. The plan made from it is that of best-fit
decreasing over all pieces at once. Open sequences with equally much room are
kept as runs; a segment tree over the capacities finds the least sufficient room
in logarithmic time. Pieces then take their places by their rank among those of
their length, in a join with the plan.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftmark.llm.common import bucket_count, growing, text_bytes
from siftmark.llm.word_ids import kept_in
from siftmark.session import materialize

#: Documents are tokenized together up to about so many bytes.
SLAB_BYTES = 2_000_000
#: Pieces of one length are ranked in buckets of about so many pieces.
RANKED = 1024


class Room:
    """A segment tree over the capacities 0..most: which have an open sequence."""

    def __init__(self, most: int):
        self.width = 1 << most.bit_length()
        self.tree = bytearray(2 * self.width)

    def set(self, room: int, is_open: bool) -> None:
        at = room + self.width
        self.tree[at] = is_open
        while at > 1:
            at >>= 1
            self.tree[at] = self.tree[2 * at] | self.tree[2 * at + 1]

    def tightest(self, length: int) -> int | None:
        """The least capacity of at least ``length`` that is open."""
        at = length + self.width
        while not self.tree[at]:
            while at & 1:  # a right child: what lies further right hangs on an ancestor
                at >>= 1
            if at == 0:
                return None
            at += 1
        while at < self.width:
            at = 2 * at if self.tree[2 * at] else 2 * at + 1
        return at - self.width


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, rank_from, rank_to, first_sequence, per_sequence, offset):
    the pieces of ``length`` with these ranks go, ``per_sequence`` at a time, to
    the sequences from ``first_sequence`` on, each from ``offset`` on."""
    plan: list[tuple[int, int, int, int, int, int]] = []
    runs: dict[int, list[tuple[int, int]]] = {}
    tree, fresh = Room(capacity), 0

    def open_run(room: int, first: int, count: int) -> None:
        if count and room:
            runs.setdefault(room, []).append((first, count))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        done, total = 0, counts[length]
        while done < total:
            room = tree.tightest(length)
            each = (room or capacity) // length
            if room is None:
                room, first, count = capacity, fresh, -(-(total - done) // each)
                fresh += count
            else:
                first, count = runs[room].pop()
                if not runs[room]:
                    tree.set(room, False)
            full = min(count, (total - done) // each)
            some = min(total - done - full * each, each - 1) if full < count else 0
            if full:
                plan.append((length, done, done + full * each, first, each, capacity - room))
            open_run(room - each * length, first, full)
            done += full * each
            if some:
                plan.append((length, done, done + some, first + full, each, capacity - room))
                open_run(room - some * length, first + full, 1)
                done += some
            open_run(room, first + full + bool(some), count - full - bool(some))
    return plan



def token_pieces(
    docs: DataFrame,
    tokenizer_json: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(id, piece, start, length, ids): every document's token ids and ``end_id``,
    cut into pieces of ``capacity``; ``ids`` are little-endian 32-bit numbers.

    ``tokenizer_json`` is the content of a tokenizer file as ``WordIds`` needs it:
    its words never reach across ASCII white space, so the ids of a text are
    those of its words. Null text is empty
    and gives the one token ``end_id``.
    """
    shared = docs.sparkSession.sparkContext.broadcast({"json": tokenizer_json})  # the size of a vocabulary
    step = 4 * capacity
    end = np.array([end_id], "<u4").tobytes()

    def coded(rows: list, words: list[list[bytes]], kind: pa.DataType) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        for row, content in zip(rows, kept_in(shared.value).ids(words)):
            content += end
            for piece, at in enumerate(range(0, len(content), step)):
                part = content[at : at + step]
                for column, value in zip(out, (row, piece, at // 4, len(part) // 4, part)):
                    column.append(value)
        kinds = (kind, pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # millions of words in few lists, and no cycles
        try:
            yield from pieces(batches)
        finally:
            gc.enable()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column(0).type
            rows, words, size = [], [], 0
            for row, content in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                rows.append(row)
                words.append(kept_in(shared.value).words(content))
                size += len(content)
                if size > SLAB_BYTES:
                    yield coded(rows, words, kind)
                    rows, words, size = [], [], 0
            if rows:
                yield coded(rows, words, kind)

    names = [id_col, "piece", "start", "length", "ids"]
    named = docs.select(F.col(id_col), F.col(text))
    key = named.schema[0].dataType.simpleString()
    return named.mapInArrow(run, f"`{id_col}` {key}, piece int, start long, length long, ids binary")


def place(pieces: DataFrame, capacity: int = 2048, length: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``, by best fit decreasing.

    Lengths outside 1..capacity, or null, are refused. ``pieces`` is read several
    times, so pass a written table. Equal rows are told apart by any order, for
    they are interchangeable. An empty table gives none.
    """
    spark = pieces.sparkSession
    names = pieces.columns
    counts = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}  # at most `capacity` rows
    if any(x is None or not 1 <= x <= capacity for x in counts):
        raise ValueError(f"lengths must be in 1..{capacity}")
    plan = spark.createDataFrame(
        best_fit_decreasing(counts, capacity),
        "_length long, _from long, _to long, _first long, _each long, _at long",
    )
    buckets = bucket_count(sum(counts.values()), RANKED)
    order = F.xxhash64(*names)
    rows = pieces.withColumn("_order", order).withColumn("_bucket", F.pmod("_order", F.lit(buckets)))
    inside = F.row_number().over(Window.partitionBy(length, "_bucket").orderBy("_order", *names)) - 1
    before = Window.partitionBy(length).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(length, "_bucket").agg(F.count("*").alias("_n"))
    starts = starts.select(length, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = (
        rows.withColumn("_in", inside)
        .join(growing(starts), [length, "_bucket"])
        .withColumn("_rank", F.col("_start") + F.col("_in"))
    )
    # the plan's rows are bounded by the capacity, not by the pieces
    placed = ranked.join(
        F.broadcast(plan),
        (F.col(length) == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")),
    ).withColumn("_nth", F.col("_rank") - F.col("_from"))
    return placed.select(
        *names,
        (F.col("_first") + F.floor(F.col("_nth") / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_at") + F.col("_nth") % F.col("_each") * F.col(length)).cast("long").alias("offset"),
    )


def packed_pieces(docs: DataFrame, tokenizer_json: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all documents.

    Null or empty text is the one token ``end_id``. Rows that repeat a doc_id are
    packed each for itself. Other columns are ignored; an empty table gives none.
    """
    pieces = token_pieces(docs, tokenizer_json, capacity, end_id).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")
    )
    return place(materialize(pieces, "pieces"), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of whole sequences, from placed pieces
    that carry ``ids``. A sequence gathers its own tokens only."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("hex"))))
    joined = F.unhex(F.array_join(F.transform(parts, lambda x: x["hex"]), ""))
    return placed.groupBy("sequence_id").agg(joined.alias("ids"))
