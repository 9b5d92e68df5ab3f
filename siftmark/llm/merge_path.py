"""Two sorted lines of token ends, merged in independent pieces of equal work.

Merging ``a`` and ``b``, ends of ``a`` first where both are equal, takes a path of
``len(a) + len(b)`` steps. The path crosses diagonal ``d`` where ``d`` ends are
merged; a binary search along the diagonal finds how many of them are from ``a``.
What lies between two diagonals is merged without the rest: each end closes a
stretch of bytes that one token of either side covers, which is one overlap.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Piece(NamedTuple):
    """Overlaps as token numbers (a, b) in order, and the overlaps at whose end both sides end."""

    a: np.ndarray
    b: np.ndarray
    shared: np.ndarray


def crossings(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many ends of ``a`` are among the first ``d`` merged, for each diagonal ``d``."""
    low = np.maximum(0, diagonals - len(b))
    high = np.minimum(diagonals, len(a))
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) // 2
        earlier = a[middle] <= b[diagonals[open_] - middle - 1]
        low[open_] = np.where(earlier, middle + 1, low[open_])
        high[open_] = np.where(earlier, high[open_], middle)


def merge_piece(a: np.ndarray, b: np.ndarray, a_from: int, a_to: int, b_from: int, b_to: int) -> Piece:
    """The overlaps closed by these ends. Where the first end of ``b`` equals the last end of
    ``a`` before the piece, its overlap is here once more, for ``stitched`` to drop."""
    own_a, own_b = a[a_from:a_to], b[b_from:b_to]
    first_b = np.searchsorted(own_b, own_a)  # the first end of b that is not before
    first_a = np.searchsorted(own_a, own_b)
    tied = np.zeros(len(own_b), bool)
    inside = first_a < len(own_a)
    tied[inside] = own_a[first_a[inside]] == own_b[inside]
    rest = np.flatnonzero(~tied)
    # a merged step's place: ends before it on either side
    place_a = np.arange(len(own_a)) + first_b
    place_b = rest + np.searchsorted(own_a, own_b[rest], side="right")
    # ends of b that are tied take no step of their own
    before = np.cumsum(tied) - tied
    place_a -= np.append(before, tied.sum())[first_b]
    place_b -= before[rest]
    out_a = np.empty(len(own_a) + len(rest), np.int64)
    out_b = np.empty_like(out_a)
    out_a[place_a], out_b[place_a] = np.arange(a_from, a_to), b_from + first_b
    out_a[place_b], out_b[place_b] = a_from + first_a[rest], b_from + rest
    return Piece(out_a, out_b, np.sort(place_a[first_a[tied]]))


def stitched(pieces: list[Piece], a: np.ndarray, b: np.ndarray) -> Piece:
    """The whole merge. An end that both sides share at a border was seen by both pieces:
    it is one overlap, the earlier piece's last, and ends a group."""
    all_a, all_b, shared = [], [], []
    done, last = 0, None
    for piece in pieces:
        drop = int(last is not None and len(piece.b) > 0 and a[last] == b[piece.b[0]] and piece.a[0] != last)
        if drop:
            shared.append(np.array([done - 1], np.int64))
        all_a.append(piece.a[drop:])
        all_b.append(piece.b[drop:])
        shared.append(piece.shared - drop + done)
        done += len(piece.a) - drop
        if len(piece.a) > drop:
            at = piece.a[-1]
            last = at if a[at] <= b[piece.b[-1]] else None  # whether an end of a is the piece's last step
    empty = [np.empty(0, np.int64)]
    return Piece(*(np.concatenate(x or empty) for x in (all_a, all_b, shared)))


def overlaps(a: np.ndarray, b: np.ndarray, work: int) -> Piece:
    """All overlaps of the tokens that end at ``a`` and at ``b``, from pieces of ``work`` ends.
    Ends rise strictly, and both lines end at the same place."""
    borders = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    of_a = crossings(a, b, borders)
    of_b = borders - of_a
    pieces = [
        merge_piece(a, b, int(of_a[k]), int(of_a[k + 1]), int(of_b[k]), int(of_b[k + 1])) for k in range(len(borders) - 1)
    ]
    return stitched(pieces, a, b)
