"""Source inference and risk classification of probes from their alignments.

A job is a gene (or a set of given probes); many jobs are classified together, keyed by `job`.
hits: job, probe_id, rname, gene_id, nm, species (nullable). sources: job, source_gene, sources (array of transcripts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids as I


def infer_source(hits: DataFrame, genes: DataFrame | None = None, is_microbiome: bool = False) -> DataFrame:
    """job, source_gene, sources: the transcript that most distinct probes hit perfectly (else at all), and its isoforms.

    Ties go to the lesser name. Isoforms are the gene's transcripts if genes (transcript, gene) are known; otherwise, except for a
    microbiome, the transcripts more than half of whose probes also hit the top one.
    """
    best = hits.where("rname <> '*'").groupBy("job", "rname", "probe_id").agg(F.min("nm").alias("nm"))
    per = best.groupBy("job", "rname").agg(F.count_if(F.col("nm") == 0).alias("perfect"), F.count("*").alias("every"))
    per = per.groupBy("job").agg(F.max("perfect").alias("any_perfect"), F.min(F.struct(-F.col("perfect"), -F.col("every"), "rname")).alias("p"), F.min(F.struct(-F.col("every"), "rname")).alias("e"))
    top = per.select("job", F.when(F.col("any_perfect") > 0, F.col("p.rname")).otherwise(F.col("e.rname")).alias("top"), (F.col("any_perfect") > 0).alias("perfect"))
    if genes is not None:
        named = top.join(genes.select(F.col("transcript").alias("top"), F.col("gene").alias("source_gene")), "top", "left")
        every = genes.select(F.col("gene").alias("source_gene"), "transcript")
        out = named.join(every, "source_gene", "left").groupBy("job", "source_gene", "top").agg(F.collect_set("transcript").alias("t"))
        return out.select("job", "source_gene", F.sort_array(F.when(F.size("t") > 0, F.col("t")).otherwise(F.array("top"))).alias("sources"))
    if is_microbiome:
        return top.select("job", F.lit(None).cast("string").alias("source_gene"), F.array("top").alias("sources"))
    used = best.join(top, "job").where(~F.col("perfect") | (F.col("nm") == 0)).select("job", "top", "rname", "probe_id")
    mine = used.where("rname = top").select("job", "probe_id", F.lit(True).alias("shared"))
    both = used.join(mine, ["job", "probe_id"], "left").groupBy("job", "top", "rname").agg(F.count("*").alias("n"), F.count("shared").alias("shared"))
    iso = both.where((F.col("rname") == F.col("top")) | (2 * F.col("shared") > F.col("n")))
    return iso.groupBy("job").agg(F.lit(None).cast("string").alias("source_gene"), F.sort_array(F.collect_set("rname")).alias("sources"))


def _risk(nm: Column) -> Column:
    return F.when(nm <= 1, "high_risk").otherwise("medium_risk")


def classify(hits: DataFrame, sources: DataFrame | None = None, is_microbiome: bool = False, is_probe_input: bool = False, genome_self_match: bool = False) -> DataFrame:
    """job, probe_id, status, total_alignments, unique_genes, min_mismatches: one aggregation over the alignments of each probe."""
    none = F.array().cast("array<string>")
    if sources is None:
        hits = hits.withColumns({"source_gene": F.lit(None).cast("string"), "sources": none})
    else:
        hits = hits.join(sources, "job", "left").withColumn("sources", F.coalesce("sources", none))
    hits = hits.where(F.col("nm").isNotNull())
    bare = F.transform("sources", lambda t: I.strip_version(t))
    exact = F.array_contains("sources", F.col("rname"))
    known = exact | F.array_contains(bare, I.strip_version(F.col("rname"))) | F.coalesce(F.col("gene_id") == F.col("source_gene"), F.lit(False))
    named = F.contains(F.col("rname"), F.replace(F.element_at(F.split("probe_id", r"\|"), -1), F.lit("transcript:"), F.lit("")))
    if genome_self_match:
        off = ~I.same_genome(I.base_id(F.col("probe_id")), F.col("rname"))
    elif is_probe_input:
        off = F.lit(True)
    else:
        off = ~known
    species = F.col("species") if "species" in hits.columns else F.lit(None)
    per = hits.groupBy("job", "probe_id").agg(
        F.count("*").alias("total_alignments"),
        F.count_distinct("gene_id").alias("unique_genes"),
        F.min("nm").alias("least"),
        F.min(F.when(off, F.col("nm"))).alias("off_mm"),
        F.bool_and(exact).alias("all_exact"),
        F.bool_or(named).alias("any_named"),
        F.bool_and(named).alias("all_named"),
        F.max(F.size("sources") > 0).alias("has_sources"),
        F.max("source_gene").alias("source_gene"),
        F.min("gene_id").alias("gene"),
        F.coalesce(F.bool_or(species != "Unknown"), F.lit(False)).alias("is_species"),
    )
    off_mm = F.col("off_mm")
    risk = _risk(F.coalesce(off_mm, F.lit(99)))
    if genome_self_match:
        status = F.when(off_mm.isNull(), "safe").otherwise(risk)
    elif is_probe_input:
        status = risk
    else:
        only_self = F.when(F.col("has_sources"), F.col("all_exact")).when(F.col("source_gene").isNotNull(), F.col("gene") == F.col("source_gene")).otherwise(F.col("any_named"))
        clean = F.when(F.col("has_sources"), F.col("all_exact")).otherwise(F.col("all_named"))
        status = F.when(F.lit(is_microbiome) & F.col("is_species"), F.when(clean, "safe").otherwise(risk))
        status = status.when(F.col("has_sources") & F.col("all_exact"), "safe")
        status = status.when((F.col("unique_genes") == 1) & only_self, "safe").otherwise(risk)
    per = per.withColumn("status", status)
    mm = F.when(F.col("status") == "safe", F.col("least")).otherwise(F.coalesce(off_mm, "least"))
    return per.select("job", "probe_id", "status", "total_alignments", "unique_genes", mm.alias("min_mismatches"))


def host_internal(hits: DataFrame) -> DataFrame:
    """job, probe_id, n_groups, safe, groups, targets: a probe is safe if all it hits is one gene group (column grp)."""
    per = hits.where("rname <> '*'").groupBy("job", "probe_id").agg(F.sort_array(F.collect_set("grp")).alias("groups"), F.sort_array(F.collect_set("rname")).alias("targets"))
    return per.select("job", "probe_id", F.size("groups").alias("n_groups"), (F.size("groups") == 1).alias("safe"), "groups", "targets")


def backfill_source(safe: DataFrame) -> DataFrame:
    """job, source_gene, sources from host-internally safe probes: all their targets; the gene only if it is unique."""
    per = safe.where("safe").select("job", F.explode("targets").alias("t"), F.col("groups")[0].alias("g"))
    out = per.groupBy("job").agg(F.sort_array(F.collect_set("t")).alias("sources"), F.count_distinct("g").alias("n"), F.min("g").alias("g"))
    return out.select("job", F.when(F.col("n") == 1, F.col("g")).alias("source_gene"), "sources")


def reject_hosts(probes: DataFrame, raw_hits: DataFrame, prefixes: list[str]) -> DataFrame:
    """Probes without any raw hit on a transcript with a host's prefix."""
    bad = F.lit(False)
    for p in prefixes:
        bad = bad | F.startswith(I.strip_version(F.col("rname")), F.lit(p))
    return probes.join(raw_hits.where(bad).select("probe_id").distinct(), "probe_id", "left_anti")


def on_target(probes: DataFrame, statuses: DataFrame, host_internal_run: bool = False, microbiome_only: bool = False) -> DataFrame:
    """Probes that go on: those without any class (not for host-internal runs) and the safe ones (not for host-only microbiome runs)."""
    joined = probes.join(statuses.select("probe_id", "status"), "probe_id", "left")
    keep = F.lit(False)
    if not host_internal_run:
        keep = keep | F.col("status").isNull()
    if not microbiome_only:
        keep = keep | (F.col("status") == "safe")
    return joined.where(F.coalesce(keep, F.lit(False)))
