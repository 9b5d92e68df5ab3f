"""Secrets found by one automaton for all rules, in one pass over the bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.llm.automaton import compile_rules
from siftmark.llm.common import text_bytes


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` with at least ``least`` bytes from the first byte at
    which the pattern could end. Matches are leftmost, longest and do not overlap;
    one that is too short is dropped, but nothing inside it is looked at again.
    In a match, no other match of the rule may begin before the first such byte."""

    kind: str
    pattern: bytes
    least: int = 1


def either_case(word: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", word)


_NAMES = either_case("(?:password|passwd|secret|token|api_?key)")
BASE = (
    Rule("assign", (_NAMES + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""").encode(), 6),
    Rule("access", rb"AKIA[A-Z0-9]+", 16),
    Rule("hex", rb"[0-9a-f]{24,}"),
)
MORE = (
    Rule("github", rb"gh[pousr]_[A-Za-z0-9]+", 36),
    Rule("slack", rb"xox[abprs]-[A-Za-z0-9-]+", 10),
    Rule("jwt", rb"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 8),
    Rule("pem", rb"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
)


def compiled(rules: Sequence[Rule]) -> tuple[np.ndarray, list[tuple[int, ...]], list, list]:
    """The rules' combined automaton as a transition array (states x 256), what its
    states accept, and each rule's own automaton forwards and backwards."""
    moves, accepted = compile_rules([r.pattern for r in rules], anywhere=True)
    forward = [compile_rules([r.pattern]) for r in rules]
    backward = [compile_rules([r.pattern], backwards=True) for r in rules]
    return np.array(moves, np.int32), accepted, forward, backward


class Scanner:
    """Scans with compiled rules."""

    def __init__(self, rules: Sequence[Rule], tables: tuple):
        moves, accepted, self.forward, self.backward = tables
        self.rules = list(rules)
        # a row of transitions holds the next rows themselves; place 256 has the rules that end here
        self.rows: list[list] = [[] for _ in accepted]
        for row, targets, ends in zip(self.rows, moves.tolist(), accepted):
            row.extend([self.rows[t] for t in targets])
            row.append(ends)

    @staticmethod
    def _longest(automaton, data: bytes, at: int, stop: int, step: int) -> int:
        """Where the longest match ends that begins at ``at`` and goes no further than ``stop``."""
        moves, accepted = automaton
        state, best = 0, at
        while at != stop:
            state = moves[state][data[at if step > 0 else at - 1]]
            if state < 0:
                break
            at += step
            if accepted[state]:
                best = at
        return best

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, in order."""
        found = []
        over = [0] * len(self.rules)
        row = self.rows[0]
        for at, byte in enumerate(data):
            row = row[byte]
            if row[256]:
                for rule in row[256]:
                    if at < over[rule]:
                        continue
                    start = self._longest(self.backward[rule], data, at + 1, over[rule], -1)
                    if start == at + 1:  # it began inside the last match
                        continue
                    end = self._longest(self.forward[rule], data, start, len(data), 1)
                    over[rule] = end
                    if end - at >= self.rules[rule].least:
                        found.append((start, rule, end))
        found.sort()
        return found


def in_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans counted in code points."""
    out, at, points = [], 0, 0
    for start, rule, end in spans:
        points += len(data[at:start].decode())
        at = start
        out.append((points, rule, points + len(data[start:end].decode())))
    return out


def secret_spans(
    docs: DataFrame, rules: Sequence[Rule] = BASE + MORE, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(id, spans): for every document an array of (kind, start, end) in code
    points, end exclusive, by start and then by the order of ``rules``.

    Null and empty texts have no spans. Rows that repeat an id get a row each; a
    null id is kept. Other columns are ignored; an empty table gives none.
    """
    kinds = [r.kind for r in rules]
    tables = docs.sparkSession.sparkContext.broadcast(compiled(rules))  # the size depends on the rules alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules, tables.value)
        for batch in batches:
            spans = [
                [{"kind": kinds[r], "start": s, "end": e} for s, r, e in in_points(x, scanner.spans(x))]
                for x in text_bytes(batch.column(1))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=[id_col, "spans"])

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    named = docs.select(F.col(id_col), F.col(text))
    key = named.schema[0].dataType.simpleString()
    return named.mapInArrow(run, f"`{id_col}` {key}, spans array<struct<kind: string, start: long, end: long>>")
