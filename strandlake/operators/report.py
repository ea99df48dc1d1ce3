"""Reports and read queries on finished alignments: summaries, pages, regions, features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions import seq as S
from ..functions import tags

# Feature colours by class.
COLOURS = {"high_risk": "#dc2626", "medium_risk": "#ea580c", "safe": "#10b981", "no_alignment": "#6b7280"}

KEY = ("probe_id", "rname", "pos", "flag")


def off_target(hits: DataFrame, sources: DataFrame | None, genome_self: bool = False) -> DataFrame:
    """Hits that are not on the probe's own source: neither its gene nor its transcripts (with or without version), nor its genome."""
    if sources is not None:
        hits = hits.join(sources, "job", "left")
        bare = F.transform(F.coalesce("sources", F.array().cast("array<string>")), lambda t: I.strip_version(t))
        own = F.array_contains(bare, I.strip_version(F.col("rname"))) | F.coalesce(F.col("gene_id") == F.col("source_gene"), F.lit(False))
        hits = hits.where(~own).drop("sources", "source_gene")
    if genome_self:
        hits = hits.where(~I.same_genome(I.base_id(F.col("probe_id")), F.col("rname")))
    return hits


def summary(hits: DataFrame, label: Column, top: int | None = None) -> DataFrame:
    """label, cnt, share of all in percent: distinct hits per label, most first, ties by label; with `top`, the rest as one row 'others'."""
    counts = hits.dropDuplicates(list(KEY)).groupBy(label.alias("label")).agg(F.count("*").alias("cnt"))
    if top is not None:
        if not 1 <= top <= 100:
            raise ValueError("top must be from 1 to 100")
        best = counts.orderBy(F.desc("cnt"), "label").limit(top)  # the feature is the top-N report
        totals = counts.agg(F.sum("cnt").alias("every"), F.count("*").alias("groups"))
        shown = best.agg(F.sum("cnt").alias("shown"), F.count("*").alias("n"))
        rest = totals.crossJoin(shown).where("groups > n").select(F.lit("others").alias("label"), (F.col("every") - F.col("shown")).alias("cnt"))  # one row with one row
        counts = best.unionByName(rest)
    total = counts.agg(F.sum("cnt").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).select("label", "cnt", (F.col("cnt") / F.col("_all") * 100).alias("pct"))  # the total is one row


def count_alignments(hits: DataFrame) -> DataFrame:
    return hits.select(*KEY).distinct().agg(F.count("*").alias("n"))


def records(hits: DataFrame) -> DataFrame:
    """Hits as shown to a reader: marked sequences, substitutions, bulges, strand, labels."""
    subs, gaps = tags.substitutions(F.col("md")), tags.bulges(F.col("cigar"))
    return hits.select(
        "probe_id", tags.marked(F.col("seq"), F.col("target")).alias("sequence"), tags.target_of(F.col("seq"), F.col("md")).alias("target_sequence"), F.col("rname").alias("target_transcript"),
        (subs + gaps).alias("mismatches"), subs.alias("substitutions"), gaps.alias("bulges"), F.col("pos").alias("position"), F.when(tags.is_reverse(F.col("flag")), "-").otherwise("+").alias("strand"),
    )


def page(hits: DataFrame, number: int, size: int) -> DataFrame:
    """A page (from 1) of the hits in a total order; filters come first."""
    if number < 1 or size < 1:
        raise ValueError("pages and sizes start at 1")
    return hits.orderBy("probe_id", "rname", "pos", "flag").offset((number - 1) * size).limit(size)


def total_pages(hits: DataFrame, size: int) -> DataFrame:
    """n, pages: how many distinct alignments there are, and pages of them (0 if none)."""
    n = F.col("n")
    return count_alignments(hits).select("n", F.ceil(n / size).cast("long").alias("pages"))


def of_probe(hits: DataFrame, probe: str) -> DataFrame:
    return hits.where((F.col("probe_id") == probe) | (I.base_id(F.col("probe_id")) == probe))


def with_errors(hits: DataFrame, n: int) -> DataFrame:
    return hits.where(tags.substitutions(F.col("md")) + tags.bulges(F.col("cigar")) == n)


def regions(probes: DataFrame, hits: DataFrame) -> DataFrame:
    """probe_id, start, end, best_mm, risk from the best hit: none is safe, up to one error high, else medium."""
    best = hits.groupBy("probe_id").agg(F.min("nm").alias("best_mm"))
    out = probes.select("probe_id", "start", "end").join(best, "probe_id", "left")
    risk = F.when(F.col("best_mm").isNull(), "safe").when(F.col("best_mm") <= 1, "high_risk").otherwise("medium_risk")
    return out.withColumn("risk", risk)


def region_totals(regions: DataFrame) -> DataFrame:
    return regions.agg(F.count("*").alias("n"), F.max("end").alias("gene_length"))


def features(probes: DataFrame, statuses: DataFrame, safe: DataFrame, host_internal: bool = False) -> DataFrame:
    """probe_id, start, end, status, mismatches, reason: class and k-mer screen together, in four states (no_alignment only in host-internal runs)."""
    joined = probes.join(statuses.select("probe_id", "status", "min_mismatches"), "probe_id", "left").join(safe.select("probe_id", F.lit(True).alias("_safe")), "probe_id", "left")
    none, on = F.col("status").isNull(), F.col("status").isNull() | (F.col("status") == "safe")
    state = F.when(on & F.col("_safe"), "safe").when(none & F.lit(host_internal), "no_alignment").when(on, "medium_risk").otherwise(F.col("status"))
    reason = F.when(on & F.col("_safe").isNull(), "kmer").when(~on, "mismatch")
    shown = F.when(on & F.col("_safe").isNull(), F.lit(None)).otherwise(F.col("min_mismatches"))
    return joined.select("probe_id", "start", "end", state.alias("status"), shown.alias("mismatches"), reason.alias("reason"))


def gff3_lines(feature_rows: DataFrame, seq_id: Column) -> DataFrame:
    """start, line: GFF3 feature lines with id, class, errors, colour and description."""
    n = F.col("mismatches").cast("string")
    is_ = lambda name: F.col("status") == name
    text = F.when(is_("safe"), "Safe: No off-target alignments").when(is_("no_alignment"), "No alignment to source gene")
    text = text.when(is_("high_risk"), F.coalesce(F.concat(F.lit("High risk: "), n, F.lit(" mismatch(es)")), F.lit("High risk: Off-target alignment")))
    text = text.when(is_("medium_risk"), F.coalesce(F.concat(F.lit("Medium risk: "), n, F.lit(" mismatches")), F.lit("Medium risk: Failed k-mer safety analysis")))
    colour = F.element_at(F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv]), F.col("status"))
    base = I.base_id(F.col("probe_id"))
    attrs = F.concat_ws(";", *[F.concat(F.lit(f"{k}="), v) for k, v in (("ID", base), ("Name", base), ("risk_level", F.col("status")), ("mismatches", n), ("color", colour), ("description", text))])
    return feature_rows.select("start", F.concat_ws("\t", seq_id, F.lit("probe_design"), F.lit("probe"), F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), F.lit("+"), F.lit("."), attrs).alias("line"))


def risk_histogram(feature_rows: DataFrame) -> DataFrame:
    s, r = F.col("status"), F.col("reason")
    return feature_rows.agg(
        F.count_if(s == "safe").alias("safe"), F.count_if(s == "high_risk").alias("high_risk"), F.count_if((s == "medium_risk") & (r == "kmer")).alias("medium_kmer"),
        F.count_if((s == "medium_risk") & (r == "mismatch")).alias("medium_mismatch"), F.count("*").alias("total"),
    )


def risk_table(hits: DataFrame, risks: DataFrame) -> DataFrame:
    """The download: one row per distinct hit of a probe with a risk, with labels."""
    table = hits.dropDuplicates(list(KEY)).join(risks.select("probe_id", "risk"), "probe_id")
    subs, gaps = tags.substitutions(F.col("md")), tags.bulges(F.col("cigar"))
    return table.select(
        "probe_id", F.col("seq").alias("probe_sequence"), S.gc_label(F.col("seq")).alias("gc"), F.col("target").alias("target_sequence"), F.col("rname").alias("target"),
        I.label(F.col("gene_id"), F.col("rname")).alias("label"), (subs + gaps).alias("mismatches"), "pos", F.when(tags.is_reverse(F.col("flag")), "-").otherwise("+").alias("strand"), "risk",
    )


def grouped(hits: DataFrame) -> DataFrame:
    """probe_id, n, best, alignments (array, best first): a probe's hits together."""
    per = hits.groupBy("probe_id").agg(F.count("*").alias("n"), F.min("nm").alias("best"), F.array_sort(F.collect_list(F.struct("nm", "rname", "pos", "flag"))).alias("a"))
    return per.select("probe_id", "n", "best", F.array_join(F.transform("a", lambda x: F.concat_ws(":", x["nm"].cast("string"), x["rname"], x["pos"].cast("string"), x["flag"].cast("string"))), ",").alias("alignments"))


def options(hits: DataFrame) -> DataFrame:
    """The distinct error counts to choose from."""
    return hits.select(F.col("nm").alias("mismatches")).distinct().orderBy("mismatches")


def bulge_options(hits: DataFrame) -> DataFrame:
    """The distinct numbers of gap bases to choose from."""
    return hits.select(tags.bulges(F.col("cigar")).alias("bulges")).distinct().orderBy("bulges")


def kmer_off_target(on_target: DataFrame, safe: DataFrame) -> DataFrame:
    """probes: how many that went into the k-mer screen didn't pass it."""
    return on_target.agg(F.count("*").alias("a")).crossJoin(safe.agg(F.count("*").alias("b"))).select(F.greatest(F.lit(0), F.col("a") - F.col("b")).alias("probes"))  # one row with one row


def metrics_table(probes: DataFrame) -> DataFrame:
    """The metrics report's nine columns in order of place, with the order-ready reverse complement; numbers as text."""
    from ..functions.structure import structure_penalty

    yes = F.when(F.col("homopolymer"), "Yes").otherwise("No")
    return probes.orderBy("gene_id", "start").select(
        "probe_id", "seq", F.format_string("%.2f", F.col("tm")).alias("tm"), F.format_string("%.1f", F.col("gc")).alias("gc"), F.length("seq").alias("length"),
        F.format_string("%.3f", F.col("complexity")).alias("complexity"), F.format_string("%.3f", structure_penalty(F.col("seq"))).alias("structure"), yes.alias("homopolymer"), S.revcomp(F.col("seq")).alias("order_seq"),
    )


def sam_lines(hits: DataFrame) -> DataFrame:
    """line: SAM records of the hits; a gene goes into the fourth column, a species into an SP tag, where the columns are there."""
    cols = [F.col("probe_id"), F.col("flag").cast("string"), F.col("rname")]
    if "gene_id" in hits.columns:
        cols.append(F.col("gene_id"))
    cols += [F.col("pos").cast("string"), F.lit("255"), F.col("cigar"), F.lit("*"), F.lit("0"), F.lit("0"), F.col("seq"), F.repeat(F.lit("I"), F.length("seq"))]
    cols += [F.concat(F.lit("NM:i:"), F.col("nm").cast("string")), F.concat(F.lit("MD:Z:"), F.col("md"))]
    if "species" in hits.columns:
        cols.append(F.concat(F.lit("SP:Z:"), F.col("species")))
    return hits.select(F.concat_ws("\t", *cols).alias("line"))


def kmer_report(per_probe: DataFrame) -> DataFrame:
    """Unsafe probes with their numbers of off-target k-mers, by id."""
    return per_probe.where("NOT safe").select("probe_id", "off_target", "total_kmers").orderBy("probe_id")


def kmer_totals(per_probe: DataFrame) -> DataFrame:
    """probes, unsafe, kmers, off_target: the head of the k-mer report."""
    return per_probe.agg(F.count("*").alias("probes"), F.count_if(~F.col("safe")).alias("unsafe"), F.sum("total_kmers").alias("kmers"), F.sum("off_target").alias("off_target"))


def ranked(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def gapped_records(hits: DataFrame) -> DataFrame:
    """records() of alignments that may hold gaps."""
    from ..functions.view import gapped_view

    view = gapped_view(F.col("seq"), F.col("cigar"), F.col("md"))
    out = hits.withColumn("_v", view)
    subs, gaps = tags.substitutions(F.col("md")), tags.bulges(F.col("cigar"))
    return out.select(
        "probe_id", F.col("_v.sequence").alias("sequence"), F.col("_v.target_sequence").alias("target_sequence"), F.col("rname").alias("target_transcript"),
        (subs + gaps).alias("mismatches"), subs.alias("substitutions"), gaps.alias("bulges"), F.col("pos").alias("position"), F.when(tags.is_reverse(F.col("flag")), "-").otherwise("+").alias("strand"),
    )


def metric_filter(probes: DataFrame, **wanted: tuple[float, float] | str) -> DataFrame:
    """Probes by shown metrics: a (low, high) range, or a text that the value's one-decimal form begins with."""
    for name, want in wanted.items():
        ok = F.startswith(F.format_string("%.1f", F.col(name)), F.lit(want)) if isinstance(want, str) else F.col(name).between(*want)
        probes = probes.where(ok)
    return probes


def identity_pct(length: int, errors: int) -> int:
    """The least identity, in whole percent, that so many errors leave."""
    return (length - errors) * 100 // length
