"""Scans of reference sequences for k-mers and seeds.

A scan encodes a batch of contigs as base codes with numpy and looks all windows up in a sorted table of wanted codes; only hits leave the
task, so nothing of the reference is shuffled. The wanted table comes from the probes. It is broadcast where its checked size allows it: a
larger set of probes takes several scans, whose results are united, and a larger set of k-mers is joined by a shuffle.

Windows never span contigs, and windows with a base other than ACGT never match. A very long contig is handled in overlapping
pieces, so a task's memory doesn't grow with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Wanted codes broadcast at once: 8 bytes each.
BLOCK = 4_000_000
PIECE = 1 << 20

_CODE = np.full(256, 4, np.uint8)
for _i, _b in enumerate(b"ACGT"):
    _CODE[_b] = _CODE[_b + 32] = _i


def encode(text: bytes) -> np.ndarray:
    return _CODE[np.frombuffer(text, np.uint8)]


def window_codes(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """2-bit code of each window of k bases (k <= 31) and whether the window holds ACGT only."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    x = np.minimum(codes, 3).astype(np.int64)
    out, done, width, run = np.zeros(n, np.int64), 0, 1, x
    while done < k:  # windows by doubling: few passes whatever k is
        if (k >> (width.bit_length() - 1)) & 1:
            out = (out << (2 * width)) | run[done : done + n]
            done += width
        if done < k:
            run = (run[:-width] << (2 * width)) | run[width:]
            width *= 2
    bad = np.concatenate(([0], np.cumsum(codes > 3)))
    return out, bad[k:] == bad[:-k]


def revcomp_codes(w: np.ndarray, k: int) -> np.ndarray:
    """Code of each window's reverse complement: complemented, its pairs of bits turned round within nibbles, bytes and the word."""
    x = ~w.astype(np.int64).view(np.uint64)
    for bits, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        x = ((x >> np.uint64(bits)) & np.uint64(mask)) | ((x & np.uint64(mask)) << np.uint64(bits))
    return (x.byteswap() >> np.uint64(64 - 2 * k)).view(np.int64)


def code_of(seq: str) -> int:
    out = 0
    for c in seq:
        out = out << 2 | "ACGT".index(c)
    return out


def sequence_of(code: int, k: int) -> str:
    return "".join("ACGT"[code >> 2 * i & 3] for i in range(k - 1, -1, -1))


def pieces(codes: np.ndarray, overlap: int) -> Iterator[tuple[int, np.ndarray]]:
    """A contig's codes as pieces that share `overlap` bases: (offset, codes)."""
    at = 0
    while True:
        yield at, codes[at : at + PIECE + overlap]
        at += PIECE
        if at + overlap >= len(codes):
            return


def found_in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where values occur in a sorted table, -1 elsewhere."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return np.where(table[at] == values, at, -1)
