"""A minimal acyclic transducer: words in, the numbers they stand for out.

Words are added in order and finished states are shared when they accept the same
endings, so the automaton is minimal. An arc carries how many words come before
those that go through it; the sum along a word's arcs is its place among all
words, and there its numbers are kept. The arcs are plain sorted arrays in one
Arrow file, which readers map into memory: processes of a machine share its pages.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa

_KINDS = {"arcs": "<i8", "targets": "<i4", "before": "<i4", "final": "<i1", "starts": "<i8", "numbers": "<u4"}


def compile_words(entries: dict[bytes, Sequence[int]]) -> dict[str, np.ndarray]:
    """The arrays of the transducer of ``entries``; its last state is the first one of every word.

    ``arcs`` are state * 256 + byte, sorted; ``targets`` and ``before`` go with them.
    """
    words = sorted(entries)
    states: dict[tuple, int] = {}
    path: list[list] = [[False, []]]  # unfinished states from the root on: final, arcs
    last = b""

    def finish(down_to: int) -> None:
        while len(path) > down_to:
            final, arcs = path.pop()
            state = states.setdefault((final, tuple(arcs)), len(states))
            if path:
                path[-1][1].append((last[len(path) - 1], state))

    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        finish(common + 1)
        path.extend([False, []] for _ in range(len(word) - common))
        path[-1][0] = True
        last = word
    finish(0)
    accepted: list[int] = []
    arcs, targets, before = [], [], []
    for state, (final, out) in enumerate(states):  # targets come before the states that lead to them
        total = int(final)
        for byte, target in out:
            arcs.append(state << 8 | byte)
            targets.append(target)
            before.append(total)
            total += accepted[target]
        accepted.append(total)
    lengths = [len(entries[w]) for w in words]
    values = {
        "arcs": arcs,
        "targets": targets,
        "before": before,
        "final": [final for final, _ in states],
        "starts": np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))),
        "numbers": [x for w in words for x in entries[w]],
    }
    return {k: np.asarray(values[k], kind) for k, kind in _KINDS.items()}


def as_file(arrays: dict[str, np.ndarray]) -> bytes:
    """The content of an Arrow file with one row: each array is a list in it."""
    columns = [pa.array([arrays[k]], pa.list_(pa.from_numpy_dtype(np.dtype(kind)))) for k, kind in _KINDS.items()]
    batch = pa.RecordBatch.from_arrays(columns, names=list(_KINDS))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


class Transducer:
    """Looks many words up at once, a byte of each at a time."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        self.root = len(arrays["final"]) - 1
        self.numbers = memoryview(arrays["numbers"]).cast("B")

    @classmethod
    def mapped(cls, path: str) -> Transducer:
        """From a file, whose arrays stay in the mapped pages."""
        row = pa.ipc.open_file(pa.memory_map(path)).get_batch(0)
        return cls({k: row.column(k).values.to_numpy() for k in _KINDS})

    def places(self, words: Sequence[bytes]) -> np.ndarray:
        """Each word's place among the entries, or -1."""
        arcs, targets, before = (self.arrays[k] for k in ("arcs", "targets", "before"))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        if not len(words) or not len(arcs):
            return np.where((lengths == 0) & bool(self.arrays["final"][self.root]), 0, -1)
        content = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        place = np.full(len(words), -1, np.int64)
        alive = np.arange(len(words))
        state = np.full(len(words), self.root, np.int64)
        total = np.zeros(len(words), np.int64)
        step = 0
        while len(alive):
            ended = lengths[alive] == step
            done = alive[ended]
            good = self.arrays["final"][state[ended]] == 1
            place[done[good]] = total[ended][good]
            alive, state, total = alive[~ended], state[~ended], total[~ended]
            wanted = state << 8 | content[starts[alive] + step]
            at = np.minimum(np.searchsorted(arcs, wanted), len(arcs) - 1)
            found = arcs[at] == wanted
            alive, at = alive[found], at[found]
            state = targets[at].astype(np.int64)
            total = total[found] + before[at]
            step += 1
        return place

    def outputs(self, words: Sequence[bytes]) -> list[bytes | None]:
        """Each word's numbers, little-endian 32-bit, or None where it is no entry."""
        place = self.places(words)
        starts = self.arrays["starts"]
        begin, end = (starts[place] * 4).tolist(), (starts[place + 1] * 4).tolist()
        return [
            bytes(self.numbers[b:e]) if p >= 0 else None for p, b, e in zip(place.tolist(), begin, end)
        ]
