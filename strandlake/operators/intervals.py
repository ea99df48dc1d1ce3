"""Look-ups of features by region, as an equi-join.

A feature has a bin: the smallest of nested, ever eight times wider bins that holds it whole. A region has a level, the narrowest at which few bins overlap it. Features with bins up to that level
are found by the bin of that level around them; those with wider bins by the one or two bins of each wider level that the region overlaps. So features and
regions are joined on bins, never on inequalities alone; a feature has as many rows as there are levels, a region a few dozen at most, and the places decide among what the bins let through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Widths of bins: 2^8 bases to 2^32; beyond, one bin for all.
LEVELS = (*range(8, 33, 3), 62)
#: Bins that a region may overlap at its own level.
FEW = 16


def _zero(x: Column) -> Column:
    return x.cast("long") - 1


def level_of(start: Column, end: Column, most: int = 1) -> Column:
    """The narrowest level at which start..end (from 1, both included) overlaps at most so many bins."""
    a, b = _zero(start), _zero(end)
    out = F.lit(LEVELS[-1])
    for level in reversed(LEVELS[:-1]):
        out = F.when(F.shiftright(b, level) - F.shiftright(a, level) < most, F.lit(level)).otherwise(out)
    return out


def stored(features: DataFrame) -> DataFrame:
    """features (with start, end), a row for each level from their own bin's on: level, bin, own. It may be written and joined again and again."""
    rows = features.withColumn("_level", level_of(F.col("start"), F.col("end"))).withColumn("level", F.explode(F.array(*map(F.lit, LEVELS)))).where("level >= _level")
    at = F.coalesce(*[F.when(F.col("level") == level, F.shiftright(_zero(F.col("start")), level)) for level in LEVELS])
    return rows.withColumns({"bin": at, "own": F.col("level") == F.col("_level")}).drop("_level")


def bins_over(start: Column, end: Column) -> Column:
    """Array of (level, bin, own): the bins that start..end overlaps at its level, and at wider ones, where only features of just that level count (own)."""
    a, b, mine = _zero(start), _zero(end), level_of(start, end, FEW)

    def at(level: int) -> Column:
        return F.transform(F.sequence(F.shiftright(a, level), F.shiftright(b, level)), lambda i: F.struct(F.lit(level).alias("level"), i.alias("bin"), (mine != level).alias("only_own")))

    none = F.array().cast("array<struct<level:int,bin:bigint,only_own:boolean>>")
    return F.concat(*[F.when(mine <= level, at(level)).otherwise(none) for level in LEVELS])


def in_regions(features: DataFrame, regions: DataFrame, by: str) -> DataFrame:
    """region, and the features' columns: every feature that overlaps a region of its sequence. features: by, start, end; regions: region, by, lo, hi (from 1, both included).

    Regions with hi < lo meet nothing; a feature that overlaps several regions has a row for each.
    """
    rows = features if {"level", "bin", "own"} <= set(features.columns) else stored(features)
    asked = regions.where("lo <= hi").select("region", by, "lo", "hi", F.explode(bins_over(F.col("lo"), F.col("hi"))).alias("b")).select("region", by, "lo", "hi", "b.*")
    found = rows.join(asked, [by, "level", "bin"]).where("start <= hi AND end >= lo AND (own OR NOT only_own)")
    return found.select("region", *[c for c in rows.columns if c not in ("level", "bin", "own")])
