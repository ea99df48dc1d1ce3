"""Banded alignment of one probe against one start, for many candidates at once.

The alignment begins at the start without a gap and ends with a base against a base. Of the ends within the band the
one with the fewest edits wins, then the one nearest to the start's diagonal, then the shorter target. Among equally
cheap paths a base against a base is preferred, then a deletion (a target base without probe base), then an insertion.
Single-base gaps are reported at their leftmost place.

All candidates of a batch go through the table, the way back and the shifting of gaps together, as numpy matrices; CIGAR and MD are read off runs of the aligned columns.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

FAR = 100
#: What a matrix of aligned columns holds besides base codes: a gap; no column.
GAP, NONE = 8, 9
_LETTERS = np.array(list("ACGTNNNNNN"))


class Hits(NamedTuple):
    """The candidates that align: their rows, edits, CIGAR, MD and how many target bases they use."""

    rows: np.ndarray
    edits: np.ndarray
    cigar: list[str]
    md: list[str]
    consumed: np.ndarray


def align(queries: np.ndarray, codes: np.ndarray, starts: np.ndarray, errors: int, bulges: int) -> Hits:
    """The rows of `queries` (base codes of one length) that align with the codes at their start."""
    n, length = queries.shape
    nothing = Hits(np.zeros(0, np.int64), np.zeros(0, np.int64), [], [], np.zeros(0, np.int64))
    if not n:
        return nothing
    band = 2 * bulges + 1
    span = length + bulges
    place = starts[:, None] + np.arange(span)
    ref = np.where(place < len(codes), codes[np.minimum(place, len(codes) - 1)], NONE)  # NONE: beyond the end
    cost = np.full((n, band), FAR, np.int16)
    cost[:, bulges] = 0
    moves = np.full((length + 1, n, band), 3, np.int8)
    alive = np.arange(n)
    for a in range(1, length + 1):
        new = np.full((len(alive), band), FAR, np.int16)
        for j in range(band):
            t = a + j - bulges  # target bases used so far
            best = np.full(len(alive), FAR, np.int16)
            move = np.full(len(alive), 3, np.int8)
            if t >= 1:
                base = ref[alive, t - 1] if t <= span else np.full(len(alive), NONE)
                there = base != NONE
                diagonal = np.where(there, cost[alive, j] + ((base != queries[alive, a - 1]) | (base > 3)), FAR)
                better = diagonal < best
                best, move = np.where(better, diagonal, best), np.where(better, 0, move)
                if j:
                    skip = np.where(there, new[:, j - 1] + 1, FAR)
                    better = skip < best
                    best, move = np.where(better, skip, best), np.where(better, 1, move)
            if j + 1 < band:
                extra = cost[alive, j + 1] + 1
                better = extra < best
                best, move = np.where(better, extra, best), np.where(better, 2, move)
            new[:, j] = np.minimum(best, FAR)
            moves[a, alive, j] = np.where(best < FAR, move, 3)
        cost[alive] = new
        alive = alive[new.min(1) <= errors]  # costs never fall along a path
        if not len(alive):
            return nothing
    # the end: fewest edits, then nearest to the diagonal, then the shorter target
    order = np.array(sorted(range(band), key=lambda j: (abs(j - bulges), j)))
    rank = np.argsort(order)
    ends = np.where((cost[alive] <= errors) & (moves[length, alive] == 0), cost[alive].astype(np.int64) * band + rank, FAR * band)
    j = ends.argmin(1)
    ok = ends[np.arange(len(alive)), j] < FAR * band
    alive, j = alive[ok], j[ok]
    edits = cost[alive, j].astype(np.int64)
    top, bottom, whole = columns(queries[alive], ref[alive], moves[:, alive], j, bulges, length + errors)
    gaps = (top == GAP) | (bottom == GAP)
    whole &= gaps.sum(1) <= bulges
    alive, edits, top, bottom = alive[whole], edits[whole], top[whole], bottom[whole]
    leftmost(top, bottom)
    first = (top != NONE).argmax(1)
    edge = np.arange(len(alive))
    ok = (top[edge, first] != GAP) & (bottom[edge, first] != GAP) & (top[:, -1] != GAP) & (bottom[:, -1] != GAP) if len(alive) else np.zeros(0, bool)
    alive, edits, top, bottom = alive[ok], edits[ok], top[ok], bottom[ok]
    return Hits(alive, edits, cigars(top, bottom), mds(top, bottom), (bottom < GAP).sum(1))


def columns(queries: np.ndarray, ref: np.ndarray, moves: np.ndarray, j: np.ndarray, bulges: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The aligned columns of each row, probe above target, flush right; and whether the way back reached the start."""
    n, length = queries.shape
    top, bottom = np.full((n, width), NONE, np.uint8), np.full((n, width), NONE, np.uint8)
    a, j, whole = np.full(n, length), j.copy(), np.ones(n, bool)
    for at in range(width - 1, -1, -1):
        rows = np.flatnonzero(a > 0)
        if not len(rows):
            break
        move = moves[a[rows], rows, j[rows]]
        lost = rows[move == 3]
        whole[lost], a[lost] = False, 0
        rows, move = rows[move != 3], move[move != 3]
        t = a[rows] + j[rows] - bulges
        top[rows, at] = np.where(move == 1, GAP, queries[rows, a[rows] - 1])
        bottom[rows, at] = np.where(move == 2, GAP, np.minimum(ref[rows, np.maximum(t - 1, 0)], 4))
        a[rows] -= move != 1
        j[rows] += np.where(move == 1, -1, np.where(move == 2, 1, 0))
    return top, bottom, whole & (a == 0)


def leftmost(top: np.ndarray, bottom: np.ndarray) -> None:
    """Put each gap before the run of its own base, matched, that it stands behind."""
    while True:
        gap = (top == GAP) | (bottom == GAP)
        base = np.where(top == GAP, bottom, top)
        behind = gap[:, 1:] & (top[:, :-1] == bottom[:, :-1]) & (top[:, :-1] == base[:, 1:]) & (base[:, 1:] < 4)
        r, c = np.nonzero(behind)
        if not len(r):
            return
        for m in (top, bottom):
            m[r, c], m[r, c + 1] = m[r, c + 1].copy(), m[r, c].copy()


def _joined(texts: list[str], rows: np.ndarray, n: int) -> list[str]:
    """The texts of each row, one behind the other."""
    edge = np.searchsorted(rows, np.arange(n + 1)).tolist()
    return ["".join(texts[a:b]) for a, b in zip(edge, edge[1:], strict=False)]


def cigars(top: np.ndarray, bottom: np.ndarray) -> list[str]:
    """Runs of aligned columns: M, I (no target base), D (no probe base)."""
    op = np.where(top == NONE, 3, np.where(bottom == GAP, 1, np.where(top == GAP, 2, 0)))
    head = np.ones(op.shape, bool)
    head[:, 1:] = op[:, 1:] != op[:, :-1]
    r, c = np.nonzero(head)
    size = np.diff(np.append(r * op.shape[1] + c, op.size))
    kind = op[r, c]
    real = kind < 3
    return _joined([f"{k}{'MID'[o]}" for k, o in zip(size[real].tolist(), kind[real].tolist(), strict=True)], r[real], len(op))


def mds(top: np.ndarray, bottom: np.ndarray) -> list[str]:
    """Runs of matches, mismatched target bases, and deleted target bases behind '^'; no run of 0 at the end."""
    n = len(top)
    r, c = np.nonzero(bottom < GAP)  # target columns
    q, t = top[r, c], bottom[r, c]
    event = np.flatnonzero((q != t) | (t > 3))
    row, deleted = r[event], q[event] == GAP
    first = np.searchsorted(r, row)  # where the row's target columns begin
    before = np.maximum(np.append(-1, event[:-1]), first - 1)
    same = event - before - 1
    on = np.zeros(len(event), bool)  # a deletion that goes on
    on[1:] = deleted[1:] & deleted[:-1] & (same[1:] == 0) & (row[1:] == row[:-1])
    texts = [x if o else f"{s}{'^' if d else ''}{x}" for s, d, o, x in zip(same.tolist(), deleted.tolist(), on.tolist(), _LETTERS[t[event]].tolist(), strict=True)]
    out = _joined(texts, row, n)
    last = np.full(n, -1)
    last[row] = event  # the last one stays
    edge = np.searchsorted(r, np.arange(n + 1))
    rest = edge[1:] - np.maximum(last + 1, edge[:-1])
    return [f"{x}{k}" if k or not x else x for x, k in zip(out, rest.tolist(), strict=True)]
