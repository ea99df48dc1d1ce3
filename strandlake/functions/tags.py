"""Column functions on alignment tags: CIGAR, MD, flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .seq import mismatches


def cigar_ops(cigar: Column) -> Column:
    """Array of (n, op)."""
    n = F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MIDNSHPX=]"), F.lit(1)), lambda x: x.cast("int"))
    op = F.regexp_extract_all(cigar, F.lit(r"\d+([MIDNSHPX=])"), F.lit(1))
    return F.zip_with(n, op, lambda a, b: F.struct(a.alias("n"), b.alias("op")))


def substitutions(md: Column) -> Column:
    """Letters of an MD tag outside deletions."""
    return F.length(F.regexp_replace(F.regexp_replace(md, r"\^[A-Z]+", ""), "[^A-Z]", ""))


def bulges(cigar: Column) -> Column:
    """Inserted and deleted bases."""
    found = F.regexp_extract_all(cigar, F.lit(r"(\d+)[ID]"), F.lit(1))
    return F.aggregate(found, F.lit(0), lambda a, x: a + x.cast("int"))


def is_reverse(flag: Column) -> Column:
    return flag.bitwiseAND(16) != 0


def md_ungapped(query: Column, target: Column) -> Column:
    """MD of an ungapped alignment; it always ends with a run, also 0."""
    at = mismatches(query, target)
    gap = lambda x, i: x - F.when(i == 0, 0).otherwise(F.get(at, i - 1)) - 1
    parts = F.transform(at, lambda x, i: F.concat(gap(x, i).cast("string"), F.substring(target, x, 1)))
    last = F.coalesce(F.get(at, F.size(at) - 1), F.lit(0))
    return F.concat(F.array_join(parts, ""), (F.length(query) - last).cast("string"))


def marked(query: Column, target: Column) -> Column:
    """The query with its mismatches in lower case (ungapped)."""
    at = mismatches(query, target)
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(query)), lambda i: F.when(F.array_contains(at, i), F.lower(F.substring(query, i, 1))).otherwise(F.substring(query, i, 1))), "")


def target_of(query: Column, md: Column) -> Column:
    """The target of an ungapped alignment from the query and its MD, mismatches in lower case."""
    runs = F.regexp_extract_all(md, F.lit(r"(\d+|[A-Z])"), F.lit(1))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        n = F.when(F.rlike(x, F.lit(r"^\d+$")), x.try_cast("int")).otherwise(1)
        piece = F.when(F.rlike(x, F.lit(r"^\d+$")), F.substr(query, acc["at"] + 1, n)).otherwise(F.lower(x))
        return F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], piece).alias("out"))

    return F.aggregate(runs, zero, step, lambda acc: acc["out"])
