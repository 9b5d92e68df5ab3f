"""Repeated windows of a corpus: which strings of ``width`` symbols start more than once.

Symbols are words or bytes. Every window holds a trigger: of the grams in it, the
one with the least rolling hash. Equal windows have equal triggers at equal
places, so windows meet by their trigger and nothing else needs to be compared.
Consecutive windows with one trigger are a run, and the symbols they cover are
the run's phrase; a document is a sequence of phrases that overlap by
``width - 1`` symbols, and each window lies in one phrase.

1. Runs are counted by trigger. A trigger met once has no repeated window.
2. Where all phrases of a trigger are equal, all their windows are repeated.
3. Else the trigger's distinct phrases are compared, each once however many
   copies there are: in tasks that hold whole triggers with few phrases, by the
   given ``solve``; triggers with more than ``LARGE`` phrases are split by longer
   prefixes, up to the whole window: windows are dealt into as many shares as
   the trigger has times ``LARGE`` phrases, and counted there, each one time
   for all phrases that a task has read together.
4. The verdicts return to the runs, and from these to the documents.

Text moves compressed and by document only: once to cut phrases, once at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.llm.common import growing, join_spread, plain_text, text_bytes
from siftmark.session import materialize

#: Phrases of one trigger that are compared in one task at most.
LARGE = 500
#: Symbols that are scanned at once: short documents together, long ones in parts.
SLAB = 400_000
#: Symbols of phrases that are compared at once.
CHUNK = 1_500_000
#: An odd factor, its inverse, and two for mixing.
BASE = 0x9E3779B97F4A7C15
MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
PLACE_BITS = np.uint64((1 << 24) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any stretches of a symbol array, from sums of symbols times powers."""

    def __init__(self):
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 2 * SLAB)
            for name, factor in (("powers", BASE), ("inverse", pow(BASE, -1, 1 << 64))):
                row = np.full(n, factor, np.uint64)
                row[0] = 1
                setattr(self, name, np.multiply.accumulate(row))

    def sums(self, symbols: np.ndarray) -> np.ndarray:
        self._reach(len(symbols) + 1)
        out = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * self.powers[: len(symbols)], out=out[1:])
        return out

    def stretch(self, sums: np.ndarray, starts, ends) -> np.ndarray:
        return mixed((sums[ends] - sums[starts]) * self.inverse[starts])


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    length, least = 1, values
    while 2 * length <= width:
        least = np.minimum(least[:-length], least[length:])
        length *= 2
    rest = width - length
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


@dataclass(frozen=True)
class Runs:
    """Finds runs. ``gram`` symbols make a trigger; a window has width - gram + 1 grams."""

    width: int
    gram: int

    @property
    def grams(self) -> int:
        return self.width - self.gram + 1

    def find(self, rolling: Rolling, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """(trigger, phrase, part, place) of the runs in concatenated parts of ``lengths``.

        ``trigger`` and ``phrase`` are hashes as signed numbers; ``place`` is the
        first window's start in its part times ``grams``, plus the number of
        further windows.
        """
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        has = lengths >= self.width
        if not has.any():
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        sums = rolling.sums(symbols)
        at = np.arange(len(symbols) - self.gram + 1)
        grams = rolling.stretch(sums, at, at + self.gram)
        first = window_least((grams & ~PLACE_BITS) | at.astype(np.uint64), self.grams)
        marks = np.zeros(len(symbols) + 1, np.int32)
        marks[offsets[:-1][has]] += 1
        marks[offsets[1:][has] - self.width + 1] -= 1
        starts = np.flatnonzero(np.cumsum(marks)[: len(first)])
        anchors = (first[starts] & PLACE_BITS).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
        count = np.diff(np.append(new, len(starts)))
        begin, anchor = starts[new], anchors[new]
        other = rolling.sums(mixed(symbols))
        phrase = rolling.stretch(other, begin, begin + count + self.width - 1)
        phrase = mixed(phrase ^ ((anchor - begin) * self.grams + count).astype(np.uint64))
        part = np.searchsorted(offsets, begin, "right") - 1
        place = (begin - offsets[part]) * self.grams + count - 1
        return grams[anchor].view(np.int64), phrase.view(np.int64), part, place


@dataclass(frozen=True)
class Symbols:
    """How a text is a sequence of symbols.

    ``split``: what is cut in slices. ``hashes``: a function that gives a 64-bit
    number for each symbol of the slices. ``join``: the bytes of a slice.
    """

    split: Callable
    hashes: Callable
    join: Callable


def packed(docs: DataFrame) -> DataFrame:
    """(_key, _id, _packed): the texts compressed for a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            made = pa.array(map(press.compress, text_bytes(batch.column(2))), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made], names=["_key", "_id", "_packed"])

    key = docs.schema["_id"].dataType.simpleString()
    return docs.select("_key", "_id", "_text").mapInArrow(run, f"_key long, _id {key}, _packed binary")


def keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(_key, _id, _text): equal rows share a key, others do not."""
    named = docs.select(F.col(id_col).alias("_id"), plain_text(text).alias("_text"))
    return named.select(F.xxhash64("_id", "_text").alias("_key"), "_id", "_text")


def _runs(docs: DataFrame, runs: Runs, symbols: Symbols) -> DataFrame:
    """(trigger, phrase, _key, place) of every run of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, hashes = Rolling(), symbols.hashes()

        def found(parts: list, keys: list[int], begins: list[int]) -> pa.RecordBatch:
            lengths = np.array([len(p) for p in parts], np.int64)
            trigger, phrase, part, place = runs.find(rolling, hashes(parts), lengths)
            place = place + np.array(begins, np.int64)[part] * runs.grams
            key = np.array(keys, np.int64)[part]
            return pa.RecordBatch.from_arrays(list(map(pa.array, (trigger, phrase, key, place))), names=names)

        for batch in batches:
            parts, keys, begins, size = [], [], [], 0
            for key, content in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                whole = symbols.split(content)
                for begin in range(0, len(whole) - runs.width + 1, SLAB):
                    part = whole[begin : begin + SLAB + runs.width - 1]
                    parts.append(part)
                    keys.append(key)
                    begins.append(begin)
                    size += len(part)
                    if size >= SLAB:
                        yield found(parts, keys, begins)
                        parts, keys, begins, size = [], [], [], 0
            if parts:
                yield found(parts, keys, begins)

    names = ["trigger", "phrase", "_key", "place"]
    return docs.select("_key", "_text").mapInArrow(run, "trigger long, phrase long, _key long, place long")


def _phrases(texts: DataFrame, classes: DataFrame, runs: Runs, symbols: Symbols) -> DataFrame:
    """(trigger, phrase, content, phrases, share, windows, counts): a row for each class,
    with its symbols, for triggers of one share. For others a row for each trigger and
    flush: its phrases, the windows of all of them in turn, and how many each has;
    and, by share, the different windows of such a row, and how often each is there.
    ``phrase`` is the first of the row's phrases in both."""
    wanted = classes.groupBy("_key").agg(F.collect_list(F.struct("trigger", "phrase", "place", "shares")).alias("_cuts"))
    # rows that are equal in all share a key, and one of them is enough
    joined = join_spread(texts, wanted, ["_key"]).select("_packed", "_cuts")

    def dealt(trigger: int, shares: int, phrases: list[int], windows: list[np.ndarray]) -> Iterator[tuple]:
        whole = np.concatenate(windows)
        yield trigger, phrases[0], None, phrases, None, whole.view(np.int64), [len(w) for w in windows]
        different, counts = np.unique(whole, return_counts=True)
        share = (different >> np.uint64(20)) % np.uint64(shares)
        order = np.argsort(share, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(share[order])) + 1):
            yield trigger, phrases[0], None, None, int(share[at[0]]), different[at].view(np.int64), counts[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, hashes, press = Rolling(), symbols.hashes(), zstandard.ZstdDecompressor()
        rows: list[tuple] = []
        many: dict[tuple[int, int], tuple[list, list]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            for (trigger, shares), found in many.items():
                rows.extend(dealt(trigger, shares, *found))
            many.clear()
            columns = zip(*rows) if rows else [()] * len(kinds)
            made = [pa.array(list(c), k) for c, k in zip(columns, kinds)]
            rows.clear()
            return pa.RecordBatch.from_arrays(made, names=names)

        for batch in batches:
            for content, cuts in zip(batch.column(0), batch.column(1)):
                whole = symbols.split(press.decompress(content.as_py()))
                for cut in cuts.as_py():
                    begin, more = divmod(cut["place"], runs.grams)
                    part = whole[begin : begin + more + runs.width]
                    if cut["shares"] > 1:
                        at = np.arange(more + 1)
                        windows = rolling.stretch(rolling.sums(mixed(hashes([part]))), at, at + runs.width)
                        phrases, own = many.setdefault((cut["trigger"], cut["shares"]), ([], []))
                        phrases.append(cut["phrase"])
                        own.append(windows)
                        size += 16 * (more + 1)
                    else:
                        rows.append((cut["trigger"], cut["phrase"], symbols.join(part), None, None, None, None))
                        size += len(rows[-1][2])
                if size > 16_000_000:
                    yield flush()
                    size = 0
        yield flush()

    names = ["trigger", "phrase", "content", "phrases", "share", "windows", "counts"]
    longs = pa.list_(pa.int64())
    kinds = (pa.int64(), pa.int64(), pa.binary(), longs, pa.int64(), longs, longs)
    return joined.mapInArrow(
        run,
        "trigger long, phrase long, content binary, phrases array<long>, share long, windows array<long>, counts array<long>",
    )


def _compared(phrases: DataFrame, runs: Runs, solve: Callable) -> DataFrame:
    """(trigger, phrase, starts): windows that phrases of a trigger share, where there are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[int, int, bytes]] = []

        def solved(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            found = solve([r[2] for r in rows])
            kept = [(r[0], r[1], s) for r, s in zip(rows, found) if len(s)]
            columns = list(zip(*kept)) or [(), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > CHUNK and row[0] != waiting[-1][0]:  # whole triggers only
                    yield solved(waiting)
                    waiting, size = [], 0
                waiting.append(row)
                size += len(row[2])
        if waiting:
            yield solved(waiting)

    names = ["trigger", "phrase", "starts"]
    rows = phrases.where("content IS NOT NULL").select("trigger", "phrase", "content")
    dealt = rows.repartition("trigger").sortWithinPartitions("trigger")
    return dealt.mapInArrow(run, "trigger long, phrase long, starts array<int>")


def _counted(phrases: DataFrame) -> DataFrame:
    """The same for triggers with many phrases, by whole windows: what a window costs
    does not grow with the trigger's phrases."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []

        def often(rows: list[tuple]) -> pa.RecordBatch:
            windows = [r[3].values.to_numpy() for r in rows]
            _, inverse = np.unique(np.concatenate(windows), return_inverse=True)
            met = np.bincount(inverse, np.concatenate([r[4].values.to_numpy() for r in rows]))
            again = np.split(met[inverse] > 1, np.cumsum([len(w) for w in windows])[:-1])
            kept = [(r[0], r[1], w[a]) for r, w, a in zip(rows, windows, again) if a.any()]
            columns = list(zip(*kept)) or [(), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

        names = ["trigger", "phrase", "often"]
        for batch in batches:
            keys = (c.to_pylist() for c in batch.columns[:3])
            for row in zip(*keys, batch.column(3), batch.column(4)):
                if waiting and (row[0], row[2]) != (waiting[-1][0], waiting[-1][2]):
                    yield often(waiting)
                    waiting = []
                waiting.append(row)
        if waiting:
            yield often(waiting)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for trigger, *lists in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
                own, windows, counts, often = (x.values.to_numpy() for x in lists)
                marked = np.split(np.isin(windows, often), np.cumsum(counts)[:-1])
                rows.extend((trigger, p, np.flatnonzero(m)) for p, m in zip(own.tolist(), marked) if m.any())
            columns = list(zip(*rows)) or [(), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()))
            made = [pa.array(list(c), k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(made, names=["trigger", "phrase", "starts"])

    met = phrases.where("share IS NOT NULL").select("trigger", "phrase", "share", "windows", "counts")
    met = met.repartition("trigger", "share").sortWithinPartitions("trigger", "share")
    often = met.mapInArrow(count, "trigger long, phrase long, often array<long>")
    often = often.groupBy("trigger", "phrase").agg(F.flatten(F.collect_list("often")).alias("often"))
    held = phrases.where("phrases IS NOT NULL").join(growing(often), ["trigger", "phrase"])
    return held.select("trigger", "phrases", "windows", "counts", "often").mapInArrow(
        mark, "trigger long, phrase long, starts array<int>"
    )


def flagged(docs: DataFrame, texts: DataFrame, runs: Runs, symbols: Symbols, solve: Callable, large: int = LARGE) -> DataFrame:
    """``texts`` with ``_runs``: an array of (place, starts) of the runs with repeated
    windows; ``starts`` are the windows in the run, null for all; ``_runs`` is null
    where there are none."""
    every = _runs(docs, runs, symbols)
    met = every.groupBy("trigger").agg(F.count("*").alias("_n"), F.min("phrase").alias("_low"), F.max("phrase").alias("_high"))
    met = met.where("_n > 1").select("trigger", (F.col("_low") == F.col("_high")).alias("same"))
    again = materialize(join_spread(every, met, ["trigger"]), "repeated-triggers")

    classes = (
        again.where("NOT same")
        .groupBy("trigger", "phrase")
        .agg(F.count("*").alias("copies"), F.min(F.struct("_key", "place")).alias("_one"))
        .select("trigger", "phrase", "copies", "_one.*")
    )
    classes = materialize(classes, "phrases")
    shares = F.ceil(F.count("*") / large).cast("long")
    sizes = classes.groupBy("trigger").agg(shares.alias("shares"))
    phrases = materialize(_phrases(texts, join_spread(classes, sizes, ["trigger"]), runs, symbols), "phrase-texts")
    solved = _compared(phrases, runs, solve).unionByName(_counted(phrases))
    verdicts = (
        classes.select("trigger", "phrase", (F.col("copies") > 1).alias("_all"))
        .join(solved, ["trigger", "phrase"], "left")
        .select("trigger", "phrase", "_all", F.when(~F.col("_all"), F.col("starts")).alias("starts"))
        .where("_all OR starts IS NOT NULL")
    )
    verdicts = materialize(verdicts, "verdicts")
    some = join_spread(again.where("NOT same"), verdicts, ["trigger", "phrase"]).select("_key", "place", "starts")
    every_window = again.where("same").select("_key", "place", F.lit(None).cast("array<int>").alias("starts"))
    lists = some.unionByName(every_window).groupBy("_key").agg(F.collect_set(F.struct("place", "starts")).alias("_runs"))
    return join_spread(texts, lists, ["_key"], "left")


def covered(n: int, found: list[dict] | None, runs: Runs) -> np.ndarray:
    """Which of ``n`` symbols lie in a repeated window."""
    marks = np.zeros(n + 1, np.int64)
    for run in found or ():
        begin, more = divmod(run["place"], runs.grams)
        if run["starts"] is None:
            marks[begin] += 1
            marks[begin + more + runs.width] -= 1
        else:
            starts = np.array(run["starts"], np.int64) + begin
            np.add.at(marks, starts, 1)
            np.add.at(marks, starts + runs.width, -1)
    return np.cumsum(marks[:-1]) > 0


def levels(names: np.ndarray, length: int, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, names, active) for depths length, 2 * length, ... up to ``width``.

    Two active places have equal names where their first ``depth`` symbols are
    equal, and names are in the order of these symbols. Places whose first
    symbols occur nowhere else become inactive: a node with one leaf.
    """
    active = np.ones(len(names), bool)
    while True:
        yield length, names, active
        if 2 * length > width:
            return
        at = np.flatnonzero(active[:-length] & active[length:])
        key = names[at] * (int(names.max(initial=0)) + 1) + names[at + length]
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        keep = counts[inverse] > 1
        more = np.zeros(len(names), np.int64)
        more[at[keep]] = inverse[keep]
        active = np.zeros(len(names), bool)
        active[at[keep]] = True
        names, length = more, 2 * length


def deepest(names: np.ndarray, length: int, width: int, starts: np.ndarray) -> np.ndarray:
    """For each of ``starts`` whether its ``width`` symbols are also those of another start."""
    for depth, found, active in levels(names, length, width):
        pass
    rest = width - depth
    at = np.flatnonzero(active[starts] & active[starts + rest])
    key = found[starts[at]] * (int(found.max(initial=0)) + 1) + found[starts[at] + rest]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    out = np.zeros(len(starts), bool)
    out[at[counts[inverse] > 1]] = True
    return out
