"""Secondary-structure penalty of probes: the most stable hairpin or self-dimer by nearest neighbours.

A structure is one chain of nested base pairs: of a strand with itself around a hairpin loop, or of two copies of the strand, antiparallel. Between two pairs of the chain lies a
stack, a single mismatch, a bulge or an interior loop; the ends have dangling bases. Dynamic programming over all pairs finds the least free energy at 37 degrees. All probes of one
length in a batch go through it together: for each span of a pair, numpy takes all places of all probes at once.

The energies are the published ones of Allawi and SantaLucia (stacks, mismatches), Bommarito et al. (dangling ends) and SantaLucia and Hicks (loops), in 1 M sodium. Special loops
(tri- and tetraloops), salt correction and coaxial stacking are left out, and a mismatch that closes a loop counts as an inner one, so values differ from those of programs that have them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .seq import ENTHALPY, ENTROPY, both_strands

# Fixed values. Enthalpy (kcal/mol) and entropy (cal/mol K) of an inner mismatch behind a pair: 5' xy 3' over 3' x'y' 5' (Allawi and SantaLucia 1997-1998, Peyret et al. 1999).
MISMATCHES = """
AG/TT 1.0 0.9  AT/TG -2.5 -8.3  AA/TG -0.6 -2.3  AG/TA -0.7 -2.3  AC/TT 0.7 0.2  AT/TC -1.2 -6.2  AA/TC 2.3 4.6  AC/TA 5.3 14.6  AA/TA 1.2 1.7  AC/TC 0.0 -4.4  AG/TG -3.1 -9.5  AT/TT -2.7 -10.8
CG/GT -4.1 -11.7  CT/GG -2.8 -8.0  CA/GG -0.7 -2.3  CG/GA -4.0 -13.2  CC/GT -0.8 -4.5  CT/GC -1.5 -6.1  CA/GC 1.9 3.7  CC/GA 0.6 -0.6  CA/GA -0.9 -4.2  CC/GC -1.5 -7.2  CG/GG -4.9 -15.3  CT/GT -5.0 -15.8
GG/CT 3.3 10.4  GT/CG -4.4 -12.3  GA/CG -0.6 -1.0  GG/CA 0.5 3.2  GC/CT 2.3 5.4  GT/CC 5.2 13.5  GA/CC 5.2 14.2  GC/CA -0.7 -3.8  GA/CA -2.9 -9.8  GC/CC 3.6 8.9  GG/CG -6.0 -15.8  GT/CT -2.2 -8.4
TG/AT -0.1 -1.7  TT/AG -1.3 -5.3  TA/AG 0.7 0.7  TG/AA 3.0 7.4  TC/AT 1.2 0.7  TT/AC 1.0 0.7  TA/AC 3.4 8.0  TC/AA 7.6 20.2  TA/AA 4.7 12.9  TC/AC 6.1 16.4  TG/AG 1.6 3.6  TT/AT 0.2 -1.5
"""
# Fixed values. The same for a base that dangles beside a pair (Bommarito et al. 2000); '.' is the missing base.
DANGLING = """
AA/.T 0.2 2.3  AC/.G -6.3 -17.1  AG/.C -3.7 -10.0  AT/.A -2.9 -7.6  CA/.T 0.6 3.3  CC/.G -4.4 -12.6  CG/.C -4.0 -11.9  CT/.A -4.1 -13.0
GA/.T -1.1 -1.6  GC/.G -5.1 -14.0  GG/.C -3.9 -10.9  GT/.A -4.2 -15.0  TA/.T -6.9 -20.0  TC/.G -4.0 -10.9  TG/.C -4.9 -13.8  TT/.A -0.2 -0.5
.A/AT -0.7 -0.8  .C/AG -2.1 -3.9  .G/AC -5.9 -16.5  .T/AA -0.5 -1.1  .A/CT 4.4 14.9  .C/CG -0.2 -0.1  .G/CC -2.6 -7.4  .T/CA 4.7 14.2
.A/GT -1.6 -3.6  .C/GG -3.9 -11.2  .G/GC -3.2 -10.4  .T/GA -4.1 -13.1  .A/TT 2.9 10.4  .C/TG -4.4 -13.1  .G/TC -5.2 -15.0  .T/TA -3.8 -12.6
"""
# Free energies (kcal/mol) of loops by unpaired bases (SantaLucia and Hicks 2004).
HAIRPIN = {3: 3.5, 4: 3.5, 5: 3.3, 6: 4.0, 7: 4.2, 8: 4.3, 9: 4.5}
BULGE = {1: 4.0, 2: 2.9, 3: 3.1, 4: 3.2, 5: 3.3, 6: 3.5, 7: 3.7, 8: 3.9, 9: 4.1}
INTERIOR = {3: 3.2, 4: 3.6, 5: 4.0, 6: 4.4, 7: 4.6, 8: 4.8, 9: 4.9}
INITIATION = 1.96
ASYMMETRY = 0.3  # for each base that one side of an interior loop has more
END_AT = 0.05  # for each end of a chain or of a loop that is A-T
KELVIN = 310.15
GAS = 0.0019872
#: Most unpaired bases in a bulge or interior loop.
WIDEST = 12


def loop_energy(table: dict[int, float], n: int) -> float:
    """Beyond the table, the logarithm of the size decides."""
    top = max(table)
    return table[n] if n in table else table[top] + 1.75 * GAS * KELVIN * float(np.log(n / top))


def _free(text: str) -> dict[str, float]:
    words = text.split()
    return {k: float(h) - KELVIN * float(s) / 1000 for k, h, s in zip(words[0::3], words[1::3], words[2::3], strict=True)}


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """step[x, y, x', y']: 5' xy 3' over 3' x'y' 5', at least one of them a pair. left[d, x, x'], right[x, x', d]: a base before the upper strand's x, behind it; twice each, by strand."""
    h, s = both_strands(ENTHALPY), both_strands(ENTROPY)
    step = np.zeros((4, 4, 4, 4))
    for x in range(4):
        for y in range(4):
            k = "ACGT"[x] + "ACGT"[y]
            step[x, y, 3 - x, 3 - y] = h[k] / 10 - KELVIN * s[k] / 10000
    for k, g in _free(MISMATCHES).items():
        x, y, u, v = ("ACGT".index(k[i]) for i in (0, 1, 3, 4))
        step[x, y, u, v] = step[v, u, y, x] = g
    behind, before = np.zeros((4, 4)), np.zeros((4, 4))  # [pair's base on the dangling strand, dangling base]: 3' dangling, 5' dangling
    for k, g in _free(DANGLING).items():
        # 'XY/.Z': X dangles 5' of the pair Y-Z; '.Y/XZ': X, on the lower strand and so 3' of it, dangles behind Z, paired with Y
        if k[3] == ".":
            before["ACGT".index(k[1]), "ACGT".index(k[0])] = g
        else:
            behind["ACGT".index(k[4]), "ACGT".index(k[3])] = g
    return step, before, behind


STEP, BEFORE, BEHIND = _tables()


class _Batch:
    """What the programs below read of probes of one length: for each diagonal d = j - i of pairs (i, j), an array with a row for each probe and a column for each i."""

    def __init__(self, code: np.ndarray):
        self.n = n = code.shape[1]
        at, other = code[:, :, None], code[:, None, :]
        pairs = at + other == 3  # A-T and C-G are complements
        ends = np.where(pairs & ((at == 0) | (at == 3)), END_AT, 0.0)
        pad = np.full((len(code), 2), -1)
        right, left = np.concatenate([code, pad], 1), np.concatenate([pad, code], 1)
        behind, ahead = (lambda k: right[:, k : k + n]), (lambda k: left[:, 2 - k : 2 - k + n])  # base i + k, base j - k

        def step(up: int, down: int) -> np.ndarray:
            """From (i, j) to (i + up, j - down)."""
            y, v = behind(up)[:, :, None], ahead(down)[:, None, :]
            return np.where((y < 0) | (v < 0), np.inf, STEP[at, np.maximum(y, 0), other, np.maximum(v, 0)])

        following = step(1, 1)
        y, v = behind(1)[:, :, None], ahead(1)[:, None, :]
        five, three = (np.where(x >= 0, t[code, np.maximum(x, 0)], 0.0) for x, t in ((ahead(1), BEFORE), (behind(1), BEHIND)))
        five, three = np.minimum(five, 0.0), np.minimum(three, 0.0)
        tables = {
            "pairs": pairs,
            "ends": ends,
            "next": following,
            "up": step(2, 1),  # across a bulge of one base on the one side or the other
            "down": step(1, 2),
            "closing": np.where((y >= 0) & (v >= 0) & (y + v != 3), following, 0.0),  # a mismatch behind the pair (i, j)
            "opening": np.where(pairs, 0.0, following),  # the mismatch (i, j) before the pair (i + 1, j - 1)
            "outside": five[:, :, None] + three[:, None, :] + ends,  # where (i, j) begins a chain: base i - 1 and base j + 1 dangle
            "inside": three[:, :, None] + five[:, None, :] + ends,  # where it ends one: base i + 1 and base j - 1
        }
        self.diagonal = {name: {d: np.ascontiguousarray(np.diagonal(t, d, 1, 2)) for d in range(1 - n, n)} for name, t in tables.items()}

    def first(self, d: int) -> int:
        """The least i on a diagonal."""
        return max(0, -d)


def _fold(b: _Batch, order: range, begin, step: int) -> Iterator[tuple[int, np.ndarray]]:
    """Least energies of chains of pairs, pair by pair along diagonals, of which each only needs those before it in `order`.

    begin(d): energy of a chain of the pair alone. step: 1 if chains grow outward, from (i + 1 + up, j - 1 - down) to (i, j); -1 if inward.
    Yields (d, energies).
    """
    n, loops = b.n, {}
    done: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # energies; with what a loop and a bulge add on their side
    for size in range(2, WIDEST + 1):
        loops[size] = loop_energy(BULGE, size), loop_energy(INTERIOR, size) if size > 2 else None
    for d in order:
        lo, count = b.first(d), n - abs(d)
        energy = begin(d).copy()
        chained = np.full_like(energy, np.inf)  # loops, before this pair's own mismatch
        bulged = np.full_like(energy, np.inf)
        for unpaired in range(WIDEST + 1):
            other = d - step * (2 + unpaired)  # the diagonal of the pair on the far side
            if other not in done:
                continue
            theirs, looped, ended = done[other]
            base = b.first(other)
            for up in range(unpaired + 1):
                # (i, j) is outer and (i + 1 + up, j - 1 - down) inner; or the other way round
                shift = 1 + up if step == 1 else -1 - up
                a, z = max(lo, base - shift), min(lo + count, base + n - abs(other) - shift)
                if a >= z:
                    continue
                here, there = slice(a - lo, z - lo), slice(a + shift - base, z + shift - base)
                down = unpaired - up
                outer = (d, here) if step == 1 else (other, there)
                if up == down == 0:
                    value = theirs[:, there] + b.diagonal["next"][outer[0]][:, outer[1]]
                elif up == down == 1:
                    middle = d - 2 if step == 1 else other - 2
                    m = slice(a - lo, z - lo) if step == 1 else there
                    m = slice(m.start + b.first(outer[0]) + 1 - b.first(middle), m.stop + b.first(outer[0]) + 1 - b.first(middle))
                    value = theirs[:, there] + b.diagonal["next"][outer[0]][:, outer[1]] + b.diagonal["next"][middle][:, m]
                elif unpaired == 1:
                    value = theirs[:, there] + (BULGE[1] + b.diagonal["up" if up else "down"][outer[0]][:, outer[1]])
                elif not up or not down:
                    np.minimum(bulged[:, here], ended[:, there] + loops[unpaired][0], out=bulged[:, here])
                    continue
                else:
                    np.minimum(chained[:, here], looped[:, there] + (loops[unpaired][1] + ASYMMETRY * abs(up - down)), out=chained[:, here])
                    continue
                np.minimum(energy[:, here], value, out=energy[:, here])
        own = _mismatch(b, d, outer=step == 1)
        energy = np.minimum(energy, np.minimum(chained + own, bulged + b.diagonal["ends"][d]))
        energy = np.where(b.diagonal["pairs"][d], energy, np.inf)
        done[d] = energy, energy + _mismatch(b, d, outer=step != 1), energy + b.diagonal["ends"][d]
        yield d, energy


def _mismatch(b: _Batch, d: int, outer: bool) -> np.ndarray:
    """What the mismatch next to each pair of a diagonal adds to a loop: behind an outer pair, before an inner one."""
    if outer:
        return b.diagonal["closing"][d]
    out = np.zeros_like(b.diagonal["ends"][d])  # before (i, j): the step from (i - 1, j + 1)
    if d + 2 in b.diagonal["opening"]:
        before, lo = b.diagonal["opening"][d + 2], b.first(d)
        a, z = max(lo, b.first(d + 2) + 1), min(lo + b.n - abs(d), b.first(d + 2) + 1 + b.n - abs(d + 2))
        if a < z:
            out[:, a - lo : z - lo] = before[:, a - 1 - b.first(d + 2) : z - 1 - b.first(d + 2)]
    return out


def hairpins(code: np.ndarray) -> np.ndarray:
    """Least free energy of a hairpin of each row, at most 0."""
    best = np.zeros(len(code))
    if code.shape[1] < 5:
        return best
    b = _Batch(code)

    def loop(d: int) -> np.ndarray:
        return loop_energy(HAIRPIN, d - 1) + b.diagonal["closing" if d > 4 else "ends"][d]

    for d, energy in _fold(b, range(4, b.n), loop, 1):
        best = np.minimum(best, (energy + b.diagonal["outside"][d]).min(1))
    return best


def dimers(code: np.ndarray) -> np.ndarray:
    """Least free energy of a duplex of two copies of each row, at most 0."""
    best = np.zeros(len(code))
    if code.shape[1] < 2:
        return best
    b = _Batch(code)
    for d, energy in _fold(b, range(b.n - 1, -b.n, -1), lambda d: INITIATION + b.diagonal["outside"][d], -1):
        best = np.minimum(best, (energy + b.diagonal["inside"][d]).min(1))
    return best


def free_energies(seqs: list[str | None], batch: int = 256) -> np.ndarray:
    """Least free energy (kcal/mol) of a hairpin or self-dimer of each sequence, at most 0; 0 for one with other letters."""
    out = np.zeros(len(seqs))
    by_length: dict[int, list[int]] = {}
    for i, s in enumerate(seqs):
        if s and not set(s.upper()) - set("ACGT"):
            by_length.setdefault(len(s), []).append(i)
    for n, rows in by_length.items():
        for a in range(0, len(rows), batch):
            part = rows[a : a + batch]
            code = np.frombuffer("".join(seqs[i] for i in part).upper().translate(str.maketrans("ACGT", "\0\1\2\3")).encode(), np.uint8).reshape(len(part), n).astype(np.int64)
            out[part] = np.minimum(hairpins(code), dimers(code))
    return out


@F.pandas_udf(T.DoubleType())
def structure_penalty(seqs: pd.Series) -> pd.Series:
    """0 (none) to 1 (10 kcal/mol or more)."""
    distinct = seqs.drop_duplicates()
    values = dict(zip(distinct, np.clip(-free_energies(distinct.tolist()) / 10, 0, 1), strict=True))
    return seqs.map(values)
