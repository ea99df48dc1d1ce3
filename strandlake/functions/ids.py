"""Column functions on identifiers and headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER_SPLIT = r"[\s|,;:()\[\]]+"


def strip_version(x: Column) -> Column:
    return F.substring_index(x, ".", 1)


def genome_of(contig: Column) -> Column:
    return F.substring_index(contig, "_", 1)


def prefixes(contig: Column) -> Column:
    """What a contig's id may be called by: itself, and all that ends before one of its underscores."""
    parts = F.split(contig, "_")
    return F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "_")), lambda p: p != "")


def same_genome(genome: Column, target: Column) -> Column:
    """The target is the genome itself or one of its contigs (genome_...); empty names match nothing."""
    hit = (target == genome) | F.startswith(target, F.concat(genome, F.lit("_")))
    return F.coalesce((F.length(genome) > 0) & (F.length(target) > 0) & hit, F.lit(False))


def header_tokens(header: Column) -> Column:
    return F.filter(F.split(header, HEADER_SPLIT), lambda t: t != "")


def token_candidates(token: Column) -> Column:
    """A token's possible names, in order: itself, without its version, its parts between underscores."""
    return F.array_distinct(F.concat(F.array(token, strip_version(token)), F.filter(F.split(token, "_"), lambda p: p != "")))


def binomial(header: Column, names: list[str]) -> Column:
    """The first of the given species names in a header (any case, any white space), or an empty text."""
    pattern = "|".join(n.replace(" ", r"\s+") for n in names)
    return F.regexp_extract(header, rf"(?i)\b({pattern})\b", 1)


def field(probe_id: Column, name: str) -> Column:
    """start or end of a probe id."""
    return F.regexp_extract(probe_id, rf"{name}=(\d+)", 1).try_cast("int")


def base_id(probe_id: Column) -> Column:
    return F.substring_index(probe_id, "|", 1)


def label(name: Column, target: Column) -> Column:
    """A gene or species name; the target where it is unknown."""
    return F.coalesce(F.nullif(name, F.lit("Unknown")), target)


def range_of(text: str, low: float, high: float) -> tuple[float, float]:
    """'42-47' or '45' as bounds, clamped."""
    parts = [float(x) for x in text.split("-")]
    lo, hi = parts[0], parts[-1]
    if len(parts) > 2 or lo > hi:
        raise ValueError(f"not a range: {text!r}")
    return max(low, lo), min(high, hi)
