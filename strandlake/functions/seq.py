"""Nucleotide column functions: all are built-in expressions that stay in the JVM."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASES = ("ACGT" * 7)[:26] * 2  # letter i of the alphabet -> ACGT[i mod 4], in both cases

# Nearest-neighbour enthalpies (kcal/mol) and entropies (cal/mol K) of Allawi and SantaLucia (1997), in tenths, by dinucleotide;
# a dinucleotide and its reverse complement share theirs.
ENTHALPY = {"AA": -79, "AT": -72, "TA": -72, "CA": -85, "GT": -84, "CT": -78, "GA": -82, "CG": -106, "GC": -98, "GG": -80}
ENTROPY = {"AA": -222, "AT": -204, "TA": -213, "CA": -227, "GT": -224, "CT": -210, "GA": -222, "CG": -272, "GC": -244, "GG": -199}
END_AT = (23, 41)  # for each end that is A or T
END_GC = (1, -28)
SODIUM = 0.390  # mol/l
STRAND = 25e-9 - 25e-9 / 2  # mol/l
GAS = 1.987
FORMAMIDE = 0.65 * 50  # degrees for 50 % formamide


def both_strands(table: dict[str, int]) -> dict[str, int]:
    comp = str.maketrans("ACGT", "TGCA")
    return {d: table[d] if d in table else table[d.translate(comp)[::-1]] for d in map("".join, product("ACGT", repeat=2))}


def to_dna(text: Column) -> Column:
    """The letters of a text as bases."""
    return F.translate(F.regexp_replace(text, "[^A-Za-z]", ""), LETTERS, BASES)


def revcomp(s: Column) -> Column:
    """Reverse complement, upper case; whatever is no base becomes N."""
    return F.reverse(F.translate(F.regexp_replace(F.upper(s), "[^ACGT]", "N"), "ACGT", "TGCA"))


def canonical(s: Column) -> Column:
    """The lesser of a k-mer and its reverse complement."""
    return F.least(s, revcomp(s))


def count_of(s: Column, base: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(base)))


def gc_percent(s: Column) -> Column:
    """G + C in percent; 0 for the empty sequence."""
    n = F.length(F.regexp_replace(s, "[^GCgc]", ""))
    return F.when(F.length(s) == 0, 0.0).otherwise(n / F.length(s) * 100)


def gc_label(s: Column) -> Column:
    """GC of an aligned sequence (gaps left out) as text; empty for an empty one."""
    bare = F.replace(s, F.lit("-"))
    return F.when(F.length(bare) == 0, "").otherwise(F.format_string("%.1f%%", gc_percent(bare)))


def homopolymer(s: Column, run: int = 5) -> Column:
    return F.rlike(s, F.lit("|".join(f"{b}{{{run}}}" for b in "ACGT")))


def complexity(s: Column) -> Column:
    """Shannon entropy of the bases over its maximum of 2 bits."""
    total = F.lit(0.0)
    for b in "ACGT":
        p = count_of(s, b) / F.length(s)
        total = total - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    return F.when(F.length(s) == 0, 0.0).otherwise(total / 2)


def tm_nn(s: Column) -> Column:
    """Melting temperature (degrees C) of a duplex of ACGT by nearest neighbours, salt- and formamide-corrected."""
    tables = [both_strands(t) for t in (ENTHALPY, ENTROPY)]
    # one pass over the dinucleotides sums both tables in whole tenths, packed as enthalpy * 2**20 + entropy
    packed = F.create_map(*[F.lit(x) for d in tables[0] for x in (d, tables[0][d] * (1 << 20) + tables[1][d])])
    pairs = F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.element_at(packed, F.substring(s, i, 2)))
    total = F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + x)
    ends = [F.when(F.substring(s, i, 1).isin("A", "T"), END_AT[0] * (1 << 20) + END_AT[1]).otherwise(END_GC[0] * (1 << 20) + END_GC[1]) for i in (1, -1)]
    total = total + ends[0] + ends[1]
    entropy = F.pmod(total + (1 << 19), F.lit(1 << 20)) - (1 << 19)
    enthalpy = ((total - entropy) / (1 << 20)) / 10
    salted = entropy / 10 + 0.368 * (F.length(s) - 1) * F.log(F.lit(SODIUM))
    celsius = 1000 * enthalpy / (salted + GAS * F.log(F.lit(STRAND))) - 273.15 - FORMAMIDE
    return F.when((F.length(s) >= 2) & ~F.rlike(s, F.lit("[^ACGT]")), celsius)


def windows(s: Column, width: int, step: int = 1) -> Column:
    """Array of (start from 1, window); empty if the sequence is shorter than a window."""
    starts = F.sequence(F.lit(1), F.length(s) - width + 1, F.lit(step))
    cut = F.transform(starts, lambda i: F.struct(i.alias("start"), F.substring(s, i, width).alias("window")))
    return F.when(F.length(s) >= width, cut).otherwise(F.array().cast("array<struct<start:int,window:string>>"))


def mismatches(a: Column, b: Column) -> Column:
    """Positions (from 1) at which two sequences of one length differ; N differs from everything."""
    at = F.sequence(F.lit(1), F.length(a))
    return F.filter(at, lambda i: (F.substring(a, i, 1) != F.substring(b, i, 1)) | (F.substring(b, i, 1) == "N"))


def rotate(s: Column, at: int) -> Column:
    """The base at a place (from 1) replaced by the next one of ACGT."""
    return F.concat(F.substring(s, 1, at - 1), F.translate(F.substring(s, at, 1), "ACGT", "CGTA"), F.substr(s, F.lit(at + 1)))
