"""Sliding-window tiling of genes and the filters on candidate probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seq as S

#: The defaults for gene input.
LENGTH, GC, TM = 36, (40.0, 80.0), (42.0, 47.0)


def tile(genes: DataFrame, length: int = LENGTH, step: int = 1, gene: str = "gene_id", seq: str = "seq") -> DataFrame:
    """gene_id, start, end (from 1, inclusive), seq for each window of each gene; windows with N are left out."""
    cut = genes.select(F.col(gene).alias("gene_id"), F.explode(S.windows(F.upper(F.col(seq)), length, step)).alias("w"))
    out = cut.select("gene_id", F.col("w.start").alias("start"), (F.col("w.start") + length - 1).alias("end"), F.col("w.window").alias("seq"))
    return out.where(~F.contains("seq", F.lit("N")))


def number(probes: DataFrame) -> DataFrame:
    """Adds probe_idx (from 0, per gene, in order of place) and the probe id that carries place and gene."""
    w = Window.partitionBy("gene_id").orderBy("start")
    out = probes.withColumn("probe_idx", F.row_number().over(w) - 1)
    return out.withColumn("probe_id", probe_id(F.col("probe_idx"), F.col("start"), F.col("end"), F.col("gene_id")))


def probe_id(idx: Column, start: Column, end: Column, gene: Column) -> Column:
    return F.format_string("probe_%s|start=%s|end=%s|%s", idx, start, end, gene)


def with_metrics(probes: DataFrame) -> DataFrame:
    """Adds gc, tm, homopolymer, complexity."""
    s = F.col("seq")
    return probes.withColumns({"gc": S.gc_percent(s), "homopolymer": S.homopolymer(s), "complexity": S.complexity(s)}).withColumn("tm", S.tm_nn(s))


def hard_filtered(probes: DataFrame) -> DataFrame:
    """Metrics as reported: rounded; a probe with a homopolymer run is rejected and has zeros."""
    bad = F.col("homopolymer")
    value = lambda c, d: F.when(bad, 0.0).otherwise(F.bround(F.col(c), d))
    return probes.withColumns({"tm": value("tm", 2), "gc": value("gc", 2), "complexity": value("complexity", 3), "rejected": bad, "reason": F.when(bad, F.lit("homopolymer run"))})


def passes(gc: tuple[float, float] | None = GC, tm: tuple[float, float] | None = TM, drop_homopolymers: bool = True) -> Column:
    """The filters of gene input, cheap ones first; None leaves one out (probe input)."""
    ok = F.lit(True)
    if gc:
        ok = ok & S.gc_percent(F.col("seq")).between(*gc)
    if drop_homopolymers:
        ok = ok & ~S.homopolymer(F.col("seq"))
    if tm:
        ok = ok & S.tm_nn(F.col("seq")).between(*tm)
    return ok


def funnel(probes: DataFrame, gc=GC, tm=TM) -> DataFrame:
    """One row per gene: how many windows each filter in turn leaves, in one pass."""
    s = F.col("seq")
    g, t, h = S.gc_percent(s).between(*gc), S.tm_nn(s).between(*tm), ~S.homopolymer(s)
    count = lambda c, name: F.count_if(c).alias(name)
    return probes.groupBy("gene_id").agg(F.count("*").alias("windows"), count(g, "gc_pass"), count(~g, "gc_reject"), count(g & t, "tm_pass"), count(g & ~t, "tm_reject"), count(g & t & ~h, "homopolymer_reject"), count(g & t & h, "candidates"))


def check_lengths(low: int, high: int, k: int | None = None, errors: int = 0, bulges: int = 0, bounds: tuple[int, int] = (14, 50)) -> None:
    """The parameter domain, checked once on the driver."""
    if not bounds[0] <= low <= high <= bounds[1]:
        raise ValueError(f"probe lengths {low}..{high} are outside {bounds}")
    if k is not None and not 1 <= k <= min(low, 31):
        raise ValueError(f"k = {k} does not fit probes of {low} bases")
    if not 0 <= errors <= 8 or not 0 <= bulges <= min(4, errors) or low // (errors + 1) < 1:
        raise ValueError("errors must be 0..8, bulges 0..4 and no more than errors, and each seed needs a base")


def check_request(length: int, k: int, errors: int, bulges: int) -> None:
    """The narrower domain of requests from a user interface: probes of 20 to 50 bases, k from 14 to the probe's length, at most 2 bulges."""
    if not 0 <= bulges <= 2:
        raise ValueError(f"bulges = {bulges} is outside 0..2")
    if not 14 <= k <= min(length, 31):
        raise ValueError(f"k = {k} is outside 14..{min(length, 31)}")
    check_lengths(length, length, k, errors, bulges, (20, 50))
