"""The whole design run: from genes or given probes to safe probes, with every intermediate table.

Candidates, alignments and k-mer counts, which several tables use, are written as stages once; each other table is a lazy DataFrame.
Many genes run as one plan: everything is keyed by `job`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids as I
from ..operators import align, annotate, classify, kmers, report, tiling
from ..sources import stage


@dataclass(frozen=True)
class Options:
    length: int = tiling.LENGTH
    errors: int = 2
    bulges: int = 0
    k: int = 16
    gc: tuple[float, float] | None = tiling.GC
    tm: tuple[float, float] | None = tiling.TM
    is_microbiome: bool = False
    host_internal: bool = False
    microbe_mode: bool = False
    host_prefixes: tuple[str, ...] = ()  # probes with any raw hit on these hosts are rejected
    host_groups: tuple[str, ...] = ()  # groups whose k-mers make a probe unsafe in the second stage


@dataclass(frozen=True)
class Design:
    candidates: DataFrame
    hits: DataFrame
    sources: DataFrame
    statuses: DataFrame
    on_target: DataFrame
    kmer_screen: DataFrame
    safe: DataFrame
    features: DataFrame
    stats: DataFrame


def of_genes(genes: DataFrame, contigs: DataFrame, options: Options = Options(), gene_map: DataFrame | None = None, species: DataFrame | None = None, headers: DataFrame | None = None) -> Design:
    """genes: gene_id, seq. contigs: contig, genome, grp, seq. headers (gene_id, header) name host sources."""
    tiling.check_lengths(options.length, options.length, options.k, options.errors, options.bulges)
    tiles = tiling.tile(genes, options.length)
    found = tiling.number(tiles.where(tiling.passes(options.gc, options.tm))).withColumn("job", F.col("gene_id"))
    return _run(found, contigs, options, gene_map, species, headers, probe_input=False, funnel=tiling.funnel(tiles, options.gc or (0, 100), options.tm or (-1000, 1000)))


def of_probes(probes: DataFrame, contigs: DataFrame, options: Options = Options(gc=None, tm=None), gene_map: DataFrame | None = None, species: DataFrame | None = None) -> Design:
    """probes: probe_id, seq, and `line`, their order, if contigs that fit several genomes' names should go to the first (else to the least id). Only the filters that are asked for apply;
    homopolymers are reported, not dropped."""
    n = F.length("seq")
    r = probes.agg(F.min(n).alias("lo"), F.max(n).alias("hi")).first()
    if r["lo"] is None:
        raise ValueError("no probes")
    tiling.check_lengths(r["lo"], r["hi"], options.k, options.errors, options.bulges)
    found = probes.where(~F.contains("seq", F.lit("N"))).where(tiling.passes(options.gc, options.tm, drop_homopolymers=False))
    found = found.select("probe_id", F.lit("probes").alias("job"), F.lit("probes").alias("gene_id"), F.lit(1).alias("start"), n.alias("end"), "seq", *(c for c in ("line",) if c in probes.columns))
    return _run(found, contigs, options, gene_map, species, None, probe_input=True)


def _sources(hits: DataFrame, options: Options, gene_map: DataFrame | None, headers: DataFrame | None, probe_input: bool) -> DataFrame | None:
    """The source of each job by mode; None: no source, so everything is off target (or judged by genome)."""
    if probe_input and not options.host_internal:
        return None
    if options.is_microbiome:
        return classify.infer_source(hits, gene_map, is_microbiome=True)
    if options.microbe_mode or headers is None or gene_map is None:
        return None
    return annotate.source_of_header(headers, gene_map).withColumnRenamed("gene_id", "job")


def _run(candidates: DataFrame, contigs: DataFrame, options: Options, gene_map: DataFrame | None, species: DataFrame | None, headers: DataFrame | None, probe_input: bool, funnel: DataFrame | None = None) -> Design:
    spark = candidates.sparkSession
    candidates = stage.keep(candidates, "candidates")
    jobs = candidates.select("probe_id", "job")
    raw = align.align_gapped(candidates.select("probe_id", "seq"), contigs, options.errors, options.bulges).join(jobs, "probe_id")
    raw = stage.keep(raw, "alignments")
    hits = align.within_budget(raw, options.errors, options.bulges)
    hits = annotate.annotate_genes(hits, gene_map) if gene_map is not None else hits.withColumn("gene_id", F.col("rname"))
    if species is not None:
        hits = annotate.annotate_species(hits, species)

    known = _sources(hits, options, gene_map, headers, probe_input)
    if options.host_internal:
        groups = annotate.gene_groups(hits, gene_map) if gene_map is not None else hits.withColumn("grp", I.strip_version(F.col("rname")))
        inner = classify.host_internal(groups)
        statuses = inner.where("safe").select("job", "probe_id", F.lit("safe").alias("status"), F.lit(0).alias("min_mismatches"))
        if known is None:
            known = classify.backfill_source(inner)
    else:
        by_genome = probe_input and options.is_microbiome
        statuses = classify.classify(hits, known, options.is_microbiome, probe_input and not by_genome, by_genome)
    statuses = stage.keep(statuses, "statuses")  # five tables use it
    sources = known if known is not None else spark.createDataFrame([], "job string, source_gene string, sources array<string>")

    on = classify.on_target(candidates, statuses, options.host_internal)
    if options.host_prefixes:
        on = classify.reject_hosts(on, raw, list(options.host_prefixes))

    words = kmers.explode_kmers(on, options.k, ("probe_id", "job"))
    counts = stage.keep(kmers.count_kmers(contigs, words, options.k), "kmer-counts")
    if probe_input and options.is_microbiome:  # a probe's own genome is named by its id
        words = words.withColumn("genome", I.base_id(F.col("probe_id")))
        order = F.col("line") if "line" in candidates.columns else F.lit(0)
        genomes = candidates.groupBy(I.base_id(F.col("probe_id")).alias("genome")).agg(F.min(F.struct(order.alias("line"), "probe_id")).alias("rank"))
        mine = contigs.drop("genome").join(kmers.genome_contigs(contigs, genomes), "contig")
        source = kmers.count_kmers(mine, words, options.k, by=("genome",))
        screen = kmers.excess(words, counts, source, own=("genome",))
    else:
        named = sources.select("job", F.explode("sources").alias("source_id"))
        if options.is_microbiome:
            own = named.select("job", I.genome_of(F.col("source_id")).alias("_k")).distinct()
            mine = contigs.withColumn("_k", I.genome_of(F.col("contig"))).join(own, "_k")
        else:
            own = named.select("job", I.strip_version(F.col("source_id")).alias("_k")).distinct()
            mine = contigs.withColumn("_k", I.strip_version(F.col("contig"))).join(own, "_k")
        source = kmers.count_kmers(mine.select("job", "seq"), words, options.k, by=("job",))
        screen = kmers.excess(words, counts, source, own=("job",))
    if options.host_groups:  # no source is excused here
        hosts = counts.where(F.col("grp").isin(*options.host_groups) & (F.col("cnt") > 0)).select("ckmer").distinct()
        bad = words.join(hosts, "ckmer", "left_semi").select("probe_id").distinct().withColumn("_host", F.lit(True))
        screen = screen.join(bad, "probe_id", "left").withColumn("safe", F.col("safe") & F.col("_host").isNull()).drop("_host")
    safe = tiling.with_metrics(on.join(screen.where("safe").select("probe_id"), "probe_id", "left_semi"))
    features = report.features(candidates, statuses, safe.select("probe_id"), options.host_internal)
    stats = stats_of(candidates, raw, hits, statuses, on, safe, funnel)
    return Design(candidates, hits, sources, statuses, on, screen, safe, features, stats)


def stats_of(candidates: DataFrame, raw: DataFrame, hits: DataFrame, statuses: DataFrame, on: DataFrame, safe: DataFrame, funnel: DataFrame | None = None) -> DataFrame:
    """stage, n: what each step of the run left, as rows of one table. All steps are tagged, united and counted in one aggregation; a step that left nothing has 0.

    funnel: what each filter of gene input passed and rejected, a row for each gene (see tiling.funnel).
    """
    aligned = statuses.select(F.explode(F.array_compact(F.array(F.lit("aligned_probes"), F.when(F.col("status") == "safe", "self_safe")))).alias("stage"))
    steps = {"candidates": candidates, "raw_alignments": raw, "filtered_alignments": hits, "on_target": on, "safe": safe}
    zero = [("aligned_probes",), ("self_safe",), *((name,) for name in steps)]
    tagged = candidates.sparkSession.createDataFrame(zero, "stage string").select("stage", F.lit(0).cast("long").alias("n"))
    tagged = tagged.union(aligned.select("stage", F.lit(1).cast("long")))
    for name, df in steps.items():
        tagged = tagged.union(df.select(F.lit(name), F.lit(1).cast("long")))
    if funnel is not None:
        parts = F.array(*[F.struct(F.lit(c).alias("stage"), F.col(c).alias("n")) for c in ("windows", "gc_pass", "gc_reject", "tm_reject", "homopolymer_reject")])
        tagged = tagged.union(funnel.select(F.explode(parts).alias("p")).select("p.stage", "p.n"))
    return tagged.groupBy("stage").agg(F.sum("n").alias("n"))
