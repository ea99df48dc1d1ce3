"""The registered queries: each operator on the driver's tables, with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions import seq as S
from ..functions import tags
from ..functions.structure import structure_penalty
from ..operators import align, annotate, classify, intervals, kmers, report, tiling
from ..sources import alignment_store, stage
from . import base as B
from . import design
from .registry import QUERIES, SQL, query

__all__ = ["QUERIES", "SQL"]


def _probe_name(df: DataFrame) -> DataFrame:
    return df.withColumn("probe_id", F.concat_ws("_", "gene_id", F.col("start").cast("string")))


R6 = lambda x: F.round(x, 6)

# ------------------------------------------------------------------------- sequences and scalars


@query(f"WITH {B.CONTIGS} SELECT contig, genome, grp, CAST(length(seq) AS INTEGER) AS n_bases, md5(seq) AS digest FROM contigs")
def seq_contigs(spark, sf):
    return B.contigs(spark, sf).select("contig", "genome", "grp", F.length("seq").alias("n_bases"), F.md5("seq").alias("digest"))


@query(f"WITH {B.CONTIGS} SELECT contig, md5({B.rc('seq')}) AS digest FROM contigs")
def revcomp(spark, sf):
    return B.contigs(spark, sf).select("contig", F.md5(S.revcomp(F.col("seq"))).alias("digest"))


@query(f"WITH {B.CONTIGS} SELECT contig, round(CASE WHEN length(seq) = 0 THEN 0 ELSE {B.gc('seq')} END, 6) AS gc FROM contigs")
def gc_content(spark, sf):
    return B.contigs(spark, sf).select("contig", R6(S.gc_percent(F.col("seq"))).alias("gc"))


@query(f'WITH {B.WINDOWS} SELECT gene_id, "start", {B.homopolymer("seq")} AS homopolymer FROM windows')
def homopolymer(spark, sf):
    return B.windows(spark, sf).select("gene_id", "start", S.homopolymer(F.col("seq")).alias("homopolymer"))


@query(f'WITH {B.WINDOWS} SELECT gene_id, "start", round({B.complexity("seq")}, 6) AS complexity FROM windows')
def complexity(spark, sf):
    return B.windows(spark, sf).select("gene_id", "start", R6(S.complexity(F.col("seq"))).alias("complexity"))


@query(f'WITH {B.WINDOWS} SELECT gene_id, "start", round({B.tm("seq")}, 6) AS tm FROM windows')
def tm_nn(spark, sf):
    return B.windows(spark, sf).select("gene_id", "start", R6(S.tm_nn(F.col("seq"))).alias("tm"))


@query(
    f'WITH {B.WINDOWS} SELECT gene_id, "start", "end", h AS homopolymer, CASE WHEN h THEN 0 ELSE round({B.tm("seq")}, 6) END AS tm, CASE WHEN h THEN 0 ELSE round({B.gc("seq")}, 6) END AS gc, '
    f'CASE WHEN h THEN 0 ELSE round({B.complexity("seq")}, 6) END AS complexity FROM (SELECT *, {B.homopolymer("seq")} AS h FROM windows)'
)
def probe_metrics(spark, sf):
    m = tiling.with_metrics(B.windows(spark, sf))
    zero = lambda c: F.when(F.col("homopolymer"), 0.0).otherwise(R6(F.col(c))).alias(c)
    return m.select("gene_id", "start", "end", "homopolymer", zero("tm"), zero("gc"), zero("complexity"))


@query()
def secondary_structure(spark, sf):
    return B.candidates(spark, sf).select("gene_id", "start", structure_penalty(F.col("seq")).alias("penalty"))


@query(f"WITH {B.CONTIGS} SELECT contig, split_part(contig, '.', 1) AS bare, split_part(contig, '_', 1) AS genome_id, contig LIKE 'src1\\_%' ESCAPE '\\' AS in_src1 FROM contigs")
def strip_version(spark, sf):
    c = F.col("contig")
    return B.contigs(spark, sf).select("contig", I.strip_version(c).alias("bare"), I.genome_of(c).alias("genome_id"), I.same_genome(F.lit("src1"), c).alias("in_src1"))


@query(
    f"WITH {B.CONTIGS}, h AS (SELECT doc_id, contig || ' (' || grp || ') | NM_' || doc_id || '.2' AS header FROM contigs), "
    r"t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(header, '[\s|,;:()\[\]]+'), lambda x: x <> '')) AS token FROM h) SELECT doc_id, token FROM t"
)
def header_tokens(spark, sf):
    h = F.concat("contig", F.lit(" ("), "grp", F.lit(") | NM_"), F.col("doc_id").cast("string"), F.lit(".2"))
    return B.contigs(spark, sf).select("doc_id", F.explode(I.header_tokens(h)).alias("token"))


@query(
    f"WITH {B.HITS}, m AS (SELECT *, {B.md()} AS md FROM hits) SELECT probe_id, flag, rname, pos, "
    "CAST(length(regexp_replace(md, '[^A-Z]', '', 'g')) AS INTEGER) AS substitutions, 0 AS bulges, flag = 16 AS reverse FROM m"
)
def cigar_md_diffs(spark, sf):
    return B.hits(spark, sf).select("probe_id", "flag", "rname", "pos", tags.substitutions(F.col("md")).alias("substitutions"), tags.bulges(F.col("cigar")).alias("bulges"), tags.is_reverse(F.col("flag")).alias("reverse"))


# ------------------------------------------------------------------------------ tiling and filters


@query(f'WITH {B.WINDOWS} SELECT gene_id, "start", "end", seq, CAST(row_number() OVER (PARTITION BY gene_id ORDER BY "start") - 1 AS INTEGER) AS probe_idx FROM windows')
def tile_probes(spark, sf):
    return tiling.number(B.windows(spark, sf)).select("gene_id", "start", "end", "seq", "probe_idx")


@query(f"""WITH {B.GENES}, n AS (SELECT gene_id, replace(seq, 'CAT', 'CNT') AS seq FROM genes)
SELECT gene_id, "start", substr(seq, "start", {B.LENGTH}) AS seq FROM (SELECT gene_id, seq, CAST(unnest(range(1, length(seq) - {B.LENGTH - 2})) AS INTEGER) AS "start" FROM n) WHERE NOT contains(substr(seq, "start", {B.LENGTH}), 'N')""")
def tile_without_n(spark, sf):
    """Windows of genes with unknown bases: none that holds one."""
    genes = B.genes(spark, sf).withColumn("seq", F.replace("seq", F.lit("CAT"), F.lit("CNT")))
    return tiling.tile(genes, B.LENGTH).select("gene_id", "start", "seq")


@query(f"WITH {B.CANDIDATES} SELECT * FROM candidates")
def filter_gc_tm_homopolymer(spark, sf):
    return B.candidates(spark, sf)


@query(
    f"""WITH {B.WINDOWS}, f AS (SELECT gene_id, {B.gc('seq')} BETWEEN 40 AND 80 AS g, {B.tm('seq')} BETWEEN 42 AND 47 AS t, NOT {B.homopolymer('seq')} AS h FROM windows)
SELECT gene_id, count(*) AS windows, count(*) FILTER (g) AS gc_pass, count(*) FILTER (NOT g) AS gc_reject, count(*) FILTER (g AND t) AS tm_pass, count(*) FILTER (g AND NOT t) AS tm_reject,
count(*) FILTER (g AND t AND NOT h) AS homopolymer_reject, count(*) FILTER (g AND t AND h) AS candidates FROM f GROUP BY gene_id"""
)
def filter_funnel(spark, sf):
    return tiling.funnel(B.windows(spark, sf))


@query(f"WITH {B.GENES} SELECT CAST(min(length(seq)) AS INTEGER) AS shortest, CAST(max(length(seq)) AS INTEGER) AS longest, count(DISTINCT length(seq)) AS lengths, count(*) AS n FROM genes")
def probe_length_stats(spark, sf):
    n = F.length("seq")
    return B.genes(spark, sf).agg(F.min(n).alias("shortest"), F.max(n).alias("longest"), F.count_distinct(n).alias("lengths"), F.count("*").alias("n"))


@query(
    f'WITH {B.WINDOWS}, m AS (SELECT *, {B.homopolymer("seq")} AS h FROM windows) SELECT gene_id, "start", CASE WHEN h THEN 0 ELSE round({B.tm("seq")}, 2) END AS tm, CASE WHEN h THEN 0 ELSE round({B.gc("seq")}, 2) END AS gc, '
    f"CASE WHEN h THEN 0 ELSE round({B.complexity('seq')}, 3) END AS complexity, h AS rejected, CASE WHEN h THEN 'homopolymer run' END AS reason FROM m"
)
def hard_filter(spark, sf):
    return tiling.hard_filtered(tiling.with_metrics(B.windows(spark, sf))).select("gene_id", "start", "tm", "gc", "complexity", "rejected", "reason")


# ------------------------------------------------------------------------------------------ k-mers


def _kmers(spark, sf):
    return kmers.explode_kmers(B.candidates(spark, sf), B.K, ("gene_id", "start"))


def _named_kmers(spark, sf):
    return _probe_name(_kmers(spark, sf)).withColumn("own", F.lit("src1"))


@query(f'WITH {B.KMERS} SELECT gene_id, "start", "at", kmer, ckmer FROM kmers')
def kmer_explode(spark, sf):
    return _kmers(spark, sf)


@query(f"WITH {B.COUNTS} SELECT ckmer, CAST(sum(cnt) AS BIGINT) AS cnt FROM counts GROUP BY ckmer")
def kmer_counts(spark, sf):
    return kmers.count_kmers(B.contigs(spark, sf), _kmers(spark, sf), B.K).groupBy("ckmer").agg(F.sum("cnt").alias("cnt"))


@query(f"WITH {B.COUNTS} SELECT grp, ckmer, CAST(sum(cnt) AS BIGINT) AS cnt FROM counts GROUP BY grp, ckmer")
def kmer_group_counts(spark, sf):
    return kmers.count_kmers(B.contigs(spark, sf), _kmers(spark, sf), B.K)


_EXCESS = f"""WITH {B.COUNTS}, g AS (SELECT ckmer, sum(cnt) AS n FROM counts GROUP BY ckmer), s AS (SELECT ckmer, sum(cnt) AS n FROM counts WHERE genome = 'src1' GROUP BY ckmer),
e AS (SELECT gene_id || '_' || "start" AS probe_id, count(*) AS total_kmers, count(*) FILTER (coalesce(g.n, 0) > coalesce(s.n, 0)) AS off_target,
  count(*) FILTER (coalesce(g.n, 0) > 0 AND coalesce(g.n, 0) <= coalesce(s.n, 0)) AS self_only FROM kmers LEFT JOIN g USING (ckmer) LEFT JOIN s USING (ckmer) GROUP BY ALL)"""


def _excess(spark, sf):
    k = _named_kmers(spark, sf)
    counts = kmers.count_kmers(B.contigs(spark, sf), k, B.K, by=("genome",))
    return kmers.excess(k, counts, counts.where("genome = 'src1'"))


@query(_EXCESS + " SELECT *, off_target = 0 AS safe FROM e")
def kmer_self_excess(spark, sf):
    return _excess(spark, sf)


@query(_EXCESS + " SELECT probe_id, off_target, total_kmers FROM e WHERE off_target > 0")
def kmer_report(spark, sf):
    return report.kmer_report(_excess(spark, sf))


@query(_EXCESS + " SELECT count(*) AS probes, count(*) FILTER (off_target > 0) AS unsafe, CAST(sum(total_kmers) AS BIGINT) AS kmers, CAST(sum(off_target) AS BIGINT) AS off_target FROM e")
def kmer_report_totals(spark, sf):
    return report.kmer_totals(_excess(spark, sf))


_FLAGSHIP = f"""WITH {B.COUNTS}, bad AS (SELECT DISTINCT gene_id, "start" FROM kmers WHERE ckmer IN (SELECT ckmer FROM counts))
SELECT gene_id, "start", "end", seq, round({B.gc('seq')}, 6) AS gc, round({B.tm('seq')}, 6) AS tm, round({B.complexity('seq')}, 6) AS complexity
FROM candidates WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.gene_id = candidates.gene_id AND bad."start" = candidates."start")"""


@query(_FLAGSHIP)
def kmer_safety(spark, sf):
    """The flagship: tile, filter, screen all k-mers against the reference, report the safe probes with metrics."""
    probes = _probe_name(B.candidates(spark, sf))
    k = kmers.explode_kmers(probes, B.K)
    counts = kmers.count_kmers(B.contigs(spark, sf), k, B.K, by=())
    safe = kmers.safe_probes(probes, k, counts)
    m = tiling.with_metrics(safe)
    return m.select("gene_id", "start", "end", "seq", R6(F.col("gc")).alias("gc"), R6(F.col("tm")).alias("tm"), R6(F.col("complexity")).alias("complexity"))


@query(f"WITH {B.COUNTS} SELECT count(DISTINCT (gene_id, \"start\")) AS probes FROM kmers SEMI JOIN counts USING (ckmer)")
def kmer_offtarget_probes(spark, sf):
    """How many candidates share a k-mer with the reference."""
    probes = _probe_name(B.candidates(spark, sf))
    k = kmers.explode_kmers(probes, B.K)
    return report.kmer_off_target(probes, kmers.safe_probes(probes, k, kmers.count_kmers(B.contigs(spark, sf), k, B.K, by=())))


@query(
    f"""WITH {B.COUNTS}, host AS (SELECT DISTINCT ckmer FROM counts WHERE grp = 'en'), x AS (SELECT gene_id, "start", count(host.ckmer) AS host_kmers FROM kmers LEFT JOIN host USING (ckmer) GROUP BY ALL)
SELECT gene_id, "start", host_kmers, host_kmers = 0 AS safe FROM x"""
)
def kmer_host_second_stage(spark, sf):
    k = _kmers(spark, sf)
    counts = kmers.count_kmers(B.contigs(spark, sf).where("grp = 'en'"), k, B.K)
    host = counts.select("ckmer", F.lit(1).alias("hit"))
    out = k.join(host, "ckmer", "left").groupBy("gene_id", "start").agg(F.count("hit").alias("host_kmers"))
    return out.withColumn("safe", F.col("host_kmers") == 0)


@query(f"WITH {B.KMERS} SELECT count(*) AS total, count(DISTINCT kmer) AS unique_kmers, round((count(*) - count(DISTINCT kmer)) / count(*) * 100, 6) AS duplicate_pct FROM kmers")
def kmer_dup_stats(spark, sf):
    return kmers.duplication(_kmers(spark, sf)).withColumn("duplicate_pct", R6(F.col("duplicate_pct")))


@query(f"WITH {B.CONTIGS} SELECT 'src1_0' AS source_id, contig, CAST(length(seq) AS INTEGER) AS n FROM contigs WHERE genome = 'src1'")
def own_sequences(spark, sf):
    sources = spark.createDataFrame([("src1_0",)], "source_id string")
    return kmers.own_sequences(B.contigs(spark, sf), sources).select("source_id", "contig", F.length("seq").alias("n"))


_UNDER = f"""WITH {B.CONTIGS}, c AS (SELECT 'GUT_' || (doc_id % 7) || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '_' || (doc_id % 5) END || '_' || doc_id AS contig FROM contigs),
g AS (SELECT * FROM (VALUES ('GUT_3_1', 1), ('GUT_3', 2), ('GUT_5', 3), ('GUT_5_2', 4), ('GUT_1_4', 5), ('GU', 6), ('GUT_6_', 7)) v(genome, "rank")),
m AS (SELECT contig, genome, row_number() OVER (PARTITION BY contig ORDER BY "rank") AS r FROM c JOIN g ON contig = genome OR starts_with(contig, genome || '_'))"""


@query(_UNDER + " SELECT contig, genome FROM m WHERE r = 1")
def own_genomes(spark, sf):
    """Whose each contig is, where the names of genomes hold underscores themselves and one may be the prefix of another."""
    c, i = B.contigs(spark, sf), lambda n: (F.col("doc_id") % n).cast("string")
    named = c.select(F.concat(F.lit("GUT_"), i(7), F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.concat(F.lit("_"), i(5))), F.lit("_"), F.col("doc_id").cast("string")).alias("contig"))
    genomes = spark.createDataFrame([("GUT_3_1", 1), ("GUT_3", 2), ("GUT_5", 3), ("GUT_5_2", 4), ("GUT_1_4", 5), ("GU", 6), ("GUT_6_", 7)], "genome string, rank int")
    return kmers.genome_contigs(named, genomes)


# --------------------------------------------------------------------------------------- alignment

_COLS = ("probe_id", "flag", "rname", "pos", "nm")


@query(f"WITH {B.HITS} SELECT seed, count(*) AS places FROM ref WHERE seed IN (SELECT seed FROM seeds) GROUP BY seed")
def seed_candidates(spark, sf):
    p = B.probes(spark, sf)
    both = p.select("seq").union(p.select(S.revcomp(F.col("seq"))))
    seeds = both.select(F.explode(F.array(*[F.substring("seq", j * B.SEED + 1, B.SEED) for j in range(B.ERRORS + 1)])).alias("ckmer")).distinct()
    # a window and its reverse complement are counted together, so the plain seeds are looked up on one strand at a time
    fwd = B.contigs(spark, sf).select(F.explode(F.sequence(F.lit(1), F.greatest(F.length("seq"), F.lit(1)), F.lit(256))).alias("at"), "seq")
    fwd = fwd.select(F.substr("seq", "at", F.lit(256 + B.SEED - 1)).alias("seq"))
    w = fwd.select(F.explode(S.windows(F.col("seq"), B.SEED)).alias("w")).select(F.col("w.window").alias("seed"))
    return w.join(seeds.withColumnRenamed("ckmer", "seed"), "seed", "left_semi").groupBy("seed").agg(F.count("*").alias("places"))


@query(f"WITH {B.HITS} SELECT {', '.join(_COLS)} FROM hits")
def align_ungapped(spark, sf):
    return B.hits(spark, sf).select(*_COLS)


@query(
    f"WITH {B.HITS}, {B.MORE_COUNTS} SELECT 'hits' AS kind, probe_id AS name, CAST(NULL AS VARCHAR) AS grp, count(*) AS n, sum(nm) AS total FROM hits GROUP BY probe_id "
    "UNION ALL SELECT 'kmers', ckmer, grp, CAST(sum(cnt) AS BIGINT), 0 FROM counts GROUP BY ckmer, grp"
)
def fused_scan(spark, sf):
    """Alignments of the probes and counts of the candidates' k-mers from one scan of the reference."""
    hits, counts = align.align_and_count(B.probes(spark, sf), _kmers(spark, sf), B.contigs(spark, sf), B.ERRORS, B.K)
    per = hits.groupBy("probe_id").agg(F.count("*").alias("n"), F.sum("nm").alias("total"))
    return per.select(F.lit("hits").alias("kind"), F.col("probe_id").alias("name"), F.lit(None).cast("string").alias("grp"), "n", "total").union(counts.select(F.lit("kmers"), "ckmer", "grp", "cnt", F.lit(0).cast("long")))


@query(f"WITH {B.HITS} SELECT probe_id, flag, rname, pos, {B.md()} AS md, seq, target FROM hits")
def align_md(spark, sf):
    return B.hits(spark, sf).select("probe_id", "flag", "rname", "pos", "md", "seq", "target")


@query(f"WITH {B.HITS} SELECT concat_ws(chr(9), probe_id, flag, rname, pos, 255, '36M', '*', 0, 0, seq, repeat('I', 36), 'NM:i:' || nm, 'MD:Z:' || {B.md()}) AS line FROM hits")
def align_sam(spark, sf):
    return report.sam_lines(B.hits(spark, sf))


@query(f"WITH {B.HITS} SELECT DISTINCT {', '.join(_COLS)} FROM hits")
def align_dedup(spark, sf):
    h = B.hits(spark, sf)
    twice = h.withColumn("line", F.lit(0)).union(h.withColumn("line", F.lit(1)))
    return align.dedup(twice).select(*_COLS)


@query(f"WITH {B.HITS} SELECT {', '.join(_COLS)} FROM hits WHERE nm <= 1")
def align_budget(spark, sf):
    return align.within_budget(B.hits(spark, sf), 1, 0).select(*_COLS)


@query(f"WITH {B.GAPPED} SELECT probe_id, flag, rname, pos, nm, q AS seq, target FROM gapped")
def align_gapped(spark, sf):
    return align.align_gapped(B.bulged(spark, sf), B.contigs(spark, sf), B.ERRORS, 1).select(*_COLS, "seq", "target")


@query(f"WITH {B.GAPPED} SELECT probe_id, flag, rname, pos, abs(length(q) - length(target)) AS bulges, nm - abs(length(q) - length(target)) AS substitutions FROM gapped")
def gapped_tags(spark, sf):
    """Gaps and substitutions of gapped alignments, from their CIGAR and MD."""
    h = align.align_gapped(B.bulged(spark, sf), B.contigs(spark, sf), B.ERRORS, 1)
    return h.select("probe_id", "flag", "rname", "pos", tags.bulges(F.col("cigar")).cast("long").alias("bulges"), tags.substitutions(F.col("md")).cast("long").alias("substitutions"))


@query(f"WITH {B.GAPPED} SELECT probe_id, flag, rname, pos, nm, target FROM gapped WHERE nm <= 1")
def gapped_budget(spark, sf):
    h = align.align_gapped(B.bulged(spark, sf), B.contigs(spark, sf), B.ERRORS, 1)
    return align.within_budget(h, 1, 1).select("probe_id", "flag", "rname", "pos", "nm", "target")


@query(f"WITH {B.PLACED} SELECT probe_id, flag, rname, pos, nm, {B.PLACED_CIGAR} AS cigar, {B.PLACED_MD} AS md FROM lined")
def gapped_cigar_md(spark, sf):
    """Gapped alignments with their CIGAR and MD: where each gap is, and which bases differ."""
    return align.align_gapped(B.bulged(spark, sf), B.contigs(spark, sf), B.ERRORS, 1).select(*_COLS, "cigar", "md")


@query(f"WITH {B.PLACED} SELECT probe_id, {B.PLACED_SEQUENCE} AS sequence, {B.PLACED_TARGET} AS target_sequence, rname AS target_transcript, pos AS position, CAST(nm AS INTEGER) AS mismatches, CASE WHEN flag = 16 THEN '-' ELSE '+' END AS strand FROM lined")
def gapped_records(spark, sf):
    """Gapped alignments as shown to a reader, with their gaps and marks."""
    h = align.align_gapped(B.bulged(spark, sf), B.contigs(spark, sf), B.ERRORS, 1)
    return report.gapped_records(h).select("probe_id", "sequence", "target_sequence", "target_transcript", "position", "mismatches", "strand")


@query(f"WITH {B.HITS} SELECT {', '.join(_COLS)}, seq, target FROM hits")
def align_join(spark, sf):
    """align_ungapped as if the probes were too many for a broadcast: one scan of the reference meets the stored seeds in a join."""
    return align.align_ungapped(B.probes(spark, sf), B.contigs(spark, sf), B.ERRORS, most=0).select(*_COLS, "seq", "target")


@query(f"WITH {B.PLACED} SELECT probe_id, flag, rname, pos, nm, {B.PLACED_CIGAR} AS cigar, {B.PLACED_MD} AS md, target FROM lined")
def align_gapped_join(spark, sf):
    """The same with gaps."""
    return align.align_gapped(B.bulged(spark, sf), B.contigs(spark, sf), B.ERRORS, 1, most=0).select(*_COLS, "cigar", "md", "target")


@query(f"WITH {B.GAPPED} SELECT DISTINCT abs(length(q) - length(target)) AS bulges FROM gapped")
def bulge_options(spark, sf):
    return report.bulge_options(align.align_gapped(B.bulged(spark, sf), B.contigs(spark, sf), B.ERRORS, 1)).select(F.col("bulges").cast("long").alias("bulges"))


@query(
    f"""WITH {B.HITS}, k0 AS (SELECT * FROM hits WHERE nm = 0), k1 AS (SELECT * FROM k0 UNION ALL SELECT * FROM hits h WHERE nm = 1 AND NOT EXISTS (SELECT 1 FROM k0 k WHERE k.probe_id = h.probe_id AND k.flag = h.flag AND k.rname = h.rname AND abs(k.pos - h.pos) < 36)),
k2 AS (SELECT * FROM k1 UNION ALL SELECT * FROM hits h WHERE nm = 2 AND NOT EXISTS (SELECT 1 FROM k1 k WHERE k.probe_id = h.probe_id AND k.flag = h.flag AND k.rname = h.rname AND abs(k.pos - h.pos) < 36)) SELECT {', '.join(_COLS)} FROM k2"""
)
def overlap_suppress(spark, sf):
    return align.suppress_overlaps(B.hits(spark, sf), B.ERRORS).select(*_COLS)


# -------------------------------------------------------------------------------------- annotation


def _genes_of(spark, sf):
    return annotate.annotate_genes(B.hits(spark, sf), B.gene_map(spark, sf))


_ANN = f"WITH {B.HITS}, {B.GENE_MAP}, a AS (SELECT hits.*, coalesce(gene, rname) AS gene_id FROM hits LEFT JOIN gene_map ON transcript = rname)"


@query(_ANN + " SELECT probe_id, flag, rname, pos, gene_id FROM a")
def annotate_gene(spark, sf):
    return _genes_of(spark, sf).select("probe_id", "flag", "rname", "pos", "gene_id")


@query(f"WITH {B.HITS}, {B.SPECIES_MAP} SELECT probe_id, flag, rname, pos, coalesce(species, 'Unknown') AS species FROM hits LEFT JOIN species_map ON genome = split_part(rname, '_', 1)")
def annotate_species(spark, sf):
    return annotate.annotate_species(B.hits(spark, sf), B.species_map(spark, sf)).select("probe_id", "flag", "rname", "pos", "species")


_PREFIXES = [("src1", "h1"), ("src12", "h2"), ("src4", "h3")]


@query(f"WITH {B.CONTIGS} SELECT contig, CASE WHEN starts_with(contig, 'src12') THEN 'h2' WHEN starts_with(contig, 'src1') THEN 'h1' WHEN starts_with(contig, 'src4') THEN 'h3' END AS host FROM contigs")
def host_by_prefix(spark, sf):
    """The host with the longest prefix of each contig's id."""
    return annotate.host_of(B.contigs(spark, sf), spark.createDataFrame(_PREFIXES, "prefix string, host string"), "contig", "host").select("contig", "host")


_GROUPS = f"""WITH {B.HITS}, {B.GENE_MAP}, bare AS (SELECT split_part(transcript, '.', 1) AS b, min(gene) AS bg FROM gene_map GROUP BY 1),
a AS (SELECT hits.*, coalesce(gene, bg, split_part(rname, '.', 1)) AS grp FROM hits LEFT JOIN gene_map ON transcript = rname LEFT JOIN bare ON b = split_part(rname, '.', 1))"""


@query(_GROUPS + f", {B.SPECIES_MAP}" + " SELECT a.probe_id, a.flag, a.rname, a.pos, coalesce(CASE WHEN starts_with(a.rname, 'src1') OR starts_with(a.rname, 'src4') THEN coalesce(gene, bg) END, species, 'Unknown') AS species FROM a LEFT JOIN gene_map ON transcript = a.rname LEFT JOIN bare ON b = split_part(a.rname, '.', 1) LEFT JOIN species_map ON genome = split_part(a.rname, '_', 1)")
def annotate_species_hosts(spark, sf):
    """Species of contigs, but the genes of transcripts of hosts."""
    prefixes = spark.createDataFrame(_PREFIXES, "prefix string, host string")
    return annotate.annotate_species(B.hits(spark, sf), B.species_map(spark, sf), B.gene_map(spark, sf), prefixes).select("probe_id", "flag", "rname", "pos", "species")


@query(_GROUPS + " SELECT probe_id, flag, rname, pos, grp FROM a")
def group_gene(spark, sf):
    return annotate.gene_groups(B.hits(spark, sf), B.gene_map(spark, sf)).select("probe_id", "flag", "rname", "pos", "grp")


def _headers(spark, sf):
    """Every gene's header names a contig of its number, with a version of its own."""
    b = B.table(spark, sf, "benchmark")
    i = F.col("item_id").cast("string")
    return b.select(F.concat(F.lit("g"), i).alias("gene_id"), F.concat(F.lit("lcl|src"), (F.col("item_id") % 20).cast("string"), F.lit("_"), i, F.lit(".9 Homo  sapiens (G"), (F.col("item_id") % 97).cast("string"), F.lit(")")).alias("header"))


_HEADER = f"""WITH {B.CONTIGS}, {B.GENE_MAP}, h AS (SELECT item_id, 'g' || item_id AS gene_id, 'src' || (item_id % 20) || '_' || item_id AS t, 'G' || (item_id % 97) AS g FROM benchmark),
bare AS (SELECT split_part(transcript, '.', 1) AS t, min(gene) AS gene FROM gene_map GROUP BY 1), named AS (SELECT gene AS g FROM gene_map GROUP BY 1),
s AS (SELECT gene_id, coalesce(bare.gene, named.g) AS source_gene FROM h LEFT JOIN bare USING (t) LEFT JOIN named USING (g))"""


@query(_HEADER + " SELECT gene_id, source_gene, array_to_string(list_sort(list(DISTINCT transcript)), ',') AS sources FROM s JOIN gene_map ON gene = source_gene GROUP BY gene_id, source_gene")
def source_from_header(spark, sf):
    out = annotate.source_of_header(_headers(spark, sf), B.gene_map(spark, sf))
    return out.select("gene_id", "source_gene", F.array_join("sources", ",").alias("sources"))


@query(f"""WITH {B.CONTIGS}, {B.GENE_MAP}, h AS (SELECT 'g' || item_id AS gene_id, 'G' || (item_id % 120) AS symbol FROM benchmark)
SELECT gene_id, symbol AS source_gene, array_to_string(list_sort(list(DISTINCT transcript)), ',') AS sources FROM h JOIN gene_map ON gene = symbol GROUP BY gene_id, symbol""")
def source_from_refseq(spark, sf):
    """Headers that name a RefSeq accession only; symbols without a transcript don't count."""
    i = F.col("item_id").cast("string")
    b = B.table(spark, sf, "benchmark")
    headers = b.select(F.concat(F.lit("g"), i).alias("gene_id"), F.concat(F.lit("NM_"), i, F.lit(".2 predicted")).alias("header"))
    refseq = b.select(F.concat(F.lit("NM_"), i).alias("accession"), F.concat(F.lit("G"), (F.col("item_id") % 120).cast("string")).alias("symbol"))
    out = annotate.source_of_header(headers, B.gene_map(spark, sf), refseq)
    return out.select("gene_id", "source_gene", F.array_join("sources", ",").alias("sources"))


@query(_HEADER + ", x AS (SELECT h.gene_id, 'transcript' AS kind, t || '.9' AS token, 'host' AS species FROM h SEMI JOIN bare USING (t) UNION SELECT gene_id, 'gene', g, 'host' FROM h SEMI JOIN named USING (g) UNION SELECT gene_id, 'binomial', 'Homo  sapiens', 'Homo sapiens' FROM h) SELECT * FROM x")
def host_tokens(spark, sf):
    m = B.gene_map(spark, sf)
    table = m.select(F.col("transcript").alias("name"), F.lit("transcript").alias("kind"), F.lit("host").alias("species")).union(m.select(I.strip_version(F.col("transcript")), F.lit("transcript"), F.lit("host")))
    table = table.union(m.select("gene", F.lit("gene"), F.lit("host"))).distinct()
    return annotate.host_tokens(_headers(spark, sf), table, ["Homo sapiens", "Mus musculus"])


_INFER = f"""WITH {B.HITS}, b AS (SELECT job, rname, probe_id, min(nm) AS nm FROM hits GROUP BY ALL), p AS (SELECT job, rname, count(*) FILTER (nm = 0) AS perfect, count(*) AS every FROM b GROUP BY ALL),
f AS (SELECT job, max(perfect) > 0 AS ok FROM p GROUP BY job),
top AS (SELECT job, ok, rname AS top FROM (SELECT p.job, ok, rname, row_number() OVER (PARTITION BY p.job ORDER BY CASE WHEN ok THEN perfect END DESC, every DESC, rname) AS r FROM p JOIN f USING (job)) WHERE r = 1),
u AS (SELECT b.job, top, rname, probe_id FROM b JOIN top USING (job) WHERE NOT ok OR nm = 0), mine AS (SELECT job, probe_id FROM u WHERE rname = top),
iso AS (SELECT u.job, rname FROM u LEFT JOIN mine USING (job, probe_id) GROUP BY u.job, top, rname HAVING rname = top OR 2 * count(mine.probe_id) > count(*)),
src AS (SELECT job, list_sort(list(rname)) AS sources FROM iso GROUP BY job)"""


@query(_INFER + " SELECT job, array_to_string(sources, ',') AS sources FROM src")
def source_infer(spark, sf):
    return classify.infer_source(stage.keep(B.hits(spark, sf), "hits")).select("job", F.array_join("sources", ",").alias("sources"))


@query(_INFER + f""", {B.GENE_MAP}, g AS (SELECT job, top, gene AS source_gene FROM top LEFT JOIN gene_map ON transcript = top)
SELECT job, source_gene, array_to_string(coalesce(list_sort(list(DISTINCT transcript) FILTER (transcript IS NOT NULL)), [top]), ',') AS sources FROM g LEFT JOIN gene_map ON gene = source_gene GROUP BY job, source_gene, top""")
def source_infer_genes(spark, sf):
    return classify.infer_source(stage.keep(B.hits(spark, sf), "hits"), B.gene_map(spark, sf)).select("job", "source_gene", F.array_join("sources", ",").alias("sources"))


# ---------------------------------------------------------------------------------- classification

_OUT = ("job", "probe_id", "status", "total_alignments", "unique_genes", "min_mismatches")
_RISK = "CASE WHEN off_mm <= 1 THEN 'high_risk' ELSE 'medium_risk' END"


def _classify_sql(off: str, status: str, head: str, join: str = "") -> str:
    return f"""{head}, c AS (SELECT a.job, probe_id, count(*) AS total_alignments, count(DISTINCT gene_id) AS unique_genes, min(nm) AS least, min(nm) FILTER ({off}) AS off_mm,
  bool_and(list_contains(coalesce(sources, []), rname)) AS exact FROM (SELECT a.*, {'sources' if join else 'NULL::VARCHAR[] AS sources'} FROM a {join}) a GROUP BY a.job, probe_id),
z AS (SELECT *, {status} AS status FROM c)
SELECT job, probe_id, status, total_alignments, unique_genes, CAST(CASE WHEN status = 'safe' THEN least ELSE coalesce(off_mm, least) END AS INTEGER) AS min_mismatches FROM z"""


_A = f"{_INFER}, {B.GENE_MAP}, a AS (SELECT hits.*, coalesce(gene, rname) AS gene_id FROM hits LEFT JOIN gene_map ON transcript = rname)"


@query(_classify_sql("NOT list_contains(list_transform(sources, lambda t: split_part(t, '.', 1)), split_part(rname, '.', 1))", f"CASE WHEN exact THEN 'safe' ELSE {_RISK} END", _A, "LEFT JOIN src USING (job)"))
def classify_gene_input(spark, sf):
    h = stage.keep(B.hits(spark, sf), "hits")
    return classify.classify(annotate.annotate_genes(h, B.gene_map(spark, sf)), classify.infer_source(h)).select(*_OUT)


_CATALOG = f"{_INFER}, {B.SPECIES_MAP}, a AS (SELECT hits.*, rname AS gene_id FROM hits), only_top AS (SELECT job, [top] AS sources FROM top)"


@query(_classify_sql("NOT list_contains(list_transform(sources, lambda t: split_part(t, '.', 1)), split_part(rname, '.', 1))", f"CASE WHEN exact THEN 'safe' ELSE {_RISK} END", _CATALOG, "LEFT JOIN only_top USING (job)"))
def classify_microbiome(spark, sf):
    """Catalog input: the source is the contig that most probes hit, and only alignments on it are its own."""
    h = annotate.annotate_species(stage.keep(B.hits(spark, sf), "hits"), B.species_map(spark, sf)).withColumn("gene_id", F.col("rname"))
    return classify.classify(h, classify.infer_source(h, is_microbiome=True), is_microbiome=True).select(*_OUT)


@query(_classify_sql("true", _RISK, _A))
def classify_probe_input(spark, sf):
    return classify.classify(_genes_of(spark, sf), is_probe_input=True).select(*_OUT)


@query(_classify_sql("NOT starts_with(rname, 'src1_')", f"CASE WHEN off_mm IS NULL THEN 'safe' ELSE {_RISK} END", f"WITH {B.HITS}, a AS (SELECT job, 'src1|' || probe_id AS probe_id, rname, nm, rname AS gene_id FROM hits)"))
def classify_same_genome(spark, sf):
    h = B.hits(spark, sf).withColumns({"probe_id": F.concat(F.lit("src1|"), "probe_id"), "gene_id": F.col("rname")})
    return classify.classify(h, genome_self_match=True).select(*_OUT)


_NAMED = f"""WITH {B.HITS}, {B.GENE_MAP}, {B.SPECIES_MAP}, a AS (SELECT job, split_part(probe_id, '|', 1) || '|transcript:src1' AS probe_id, rname, nm, coalesce(gene, rname) AS gene_id, coalesce(species, 'Unknown') AS species
  FROM hits LEFT JOIN gene_map ON transcript = rname LEFT JOIN species_map ON genome = split_part(rname, '_', 1)),
c AS (SELECT job, probe_id, count(*) AS total_alignments, count(DISTINCT gene_id) AS unique_genes, min(nm) AS least, min(nm) AS off_mm, bool_or(contains(rname, 'src1')) AS any_named, bool_and(contains(rname, 'src1')) AS all_named,
  bool_or(species <> 'Unknown') AS is_species FROM a GROUP BY job, probe_id)"""
_NAMED_OUT = " SELECT job, probe_id, {status} AS status, total_alignments, unique_genes, least AS min_mismatches FROM c"
_BY_NAME = f"CASE WHEN unique_genes = 1 AND any_named THEN 'safe' ELSE {_RISK} END"


def _named_hits(spark, sf) -> DataFrame:
    """Alignments whose probes name a part of their source's id, and no source is known."""
    return _genes_of(spark, sf).withColumn("probe_id", F.concat(I.base_id(F.col("probe_id")), F.lit("|transcript:src1")))


@query(_NAMED + _NAMED_OUT.format(status=_BY_NAME))
def classify_by_name(spark, sf):
    return classify.classify(_named_hits(spark, sf)).select(*_OUT)


@query(_NAMED + _NAMED_OUT.format(status=f"CASE WHEN is_species THEN CASE WHEN all_named THEN 'safe' ELSE {_RISK} END ELSE {_BY_NAME} END"))
def classify_by_name_species(spark, sf):
    """The same against catalogs: probes with a known species are safe only if all their alignments are named."""
    return classify.classify(annotate.annotate_species(_named_hits(spark, sf), B.species_map(spark, sf)), is_microbiome=True).select(*_OUT)


@query(_GROUPS + """, p AS (SELECT job, probe_id, list_sort(list(DISTINCT grp)) AS groups, list_sort(list(DISTINCT rname)) AS targets FROM a GROUP BY ALL)
SELECT job, probe_id, CAST(len(groups) AS INTEGER) AS n_groups, len(groups) = 1 AS safe, array_to_string(groups, ',') AS groups, array_to_string(targets, ',') AS targets FROM p""")
def host_internal(spark, sf):
    out = classify.host_internal(annotate.gene_groups(B.hits(spark, sf), B.gene_map(spark, sf)))
    return out.withColumns({"groups": F.array_join("groups", ","), "targets": F.array_join("targets", ",")})


@query(_GROUPS + """, p AS (SELECT job, probe_id, min(grp) AS g, list(DISTINCT rname) AS t FROM a GROUP BY ALL HAVING count(DISTINCT grp) = 1), x AS (SELECT job, g, unnest(t) AS t FROM p)
SELECT job, CASE WHEN count(DISTINCT g) = 1 THEN min(g) END AS source_gene, array_to_string(list_sort(list(DISTINCT t)), ',') AS sources FROM x GROUP BY job""")
def source_backfill(spark, sf):
    out = classify.backfill_source(classify.host_internal(annotate.gene_groups(B.hits(spark, sf), B.gene_map(spark, sf))))
    return out.withColumn("sources", F.array_join("sources", ","))


@query(f'WITH {B.HITS} SELECT probe_id, "start" FROM probes WHERE probe_id NOT IN (SELECT probe_id FROM hits WHERE starts_with(rname, \'src1\') OR starts_with(rname, \'src4\'))')
def strict_host_reject(spark, sf):
    return classify.reject_hosts(B.probes(spark, sf), B.hits(spark, sf), ["src1", "src4"]).select("probe_id", "start")


_REGIONS = f"""WITH {B.HITS}, r AS (SELECT probes.probe_id, "start", "end", min(nm) AS best_mm FROM probes LEFT JOIN hits USING (probe_id) GROUP BY ALL),
regions AS (SELECT *, CASE WHEN best_mm IS NULL THEN 'safe' WHEN best_mm <= 1 THEN 'high_risk' ELSE 'medium_risk' END AS risk FROM r)"""


@query(_REGIONS + " SELECT * FROM regions")
def probe_regions(spark, sf):
    return report.regions(B.probes(spark, sf), B.hits(spark, sf))


@query(_REGIONS + ' SELECT count(*) AS n, max("end") AS gene_length FROM regions')
def region_totals(spark, sf):
    return report.region_totals(report.regions(B.probes(spark, sf), B.hits(spark, sf)))


def features(spark, sf):
    """The probes' classes together with their k-mer screen."""
    p = B.probes(spark, sf)
    statuses = classify.classify(_genes_of(spark, sf), is_probe_input=True)
    words = kmers.explode_kmers(p, B.K)
    return report.features(p, statuses, kmers.safe_probes(p, words, kmers.count_kmers(B.contigs(spark, sf), words, B.K, by=())))


_FEATURES = f"""WITH {B.HITS}, {B.SCREEN}, m AS (SELECT probe_id, min(nm) AS mm FROM hits GROUP BY 1), f AS (SELECT probes.probe_id, "start", "end",
  CASE WHEN mm IS NULL THEN CASE WHEN screened.probe_id IS NULL THEN 'medium_risk' ELSE 'safe' END WHEN mm <= 1 THEN 'high_risk' ELSE 'medium_risk' END AS status, mm AS mismatches,
  CASE WHEN mm IS NOT NULL THEN 'mismatch' WHEN screened.probe_id IS NULL THEN 'kmer' END AS reason FROM probes LEFT JOIN m USING (probe_id) LEFT JOIN screened ON screened.probe_id = probes.probe_id)"""


@query(_FEATURES + " SELECT * FROM f")
def gff3_features(spark, sf):
    return features(spark, sf)


_REGION = "VALUES ('first', 1, 120), ('inner', 200, 260), ('none', 50, 40), ('far', 300, 100000000)"


@query(_FEATURES + f""", r AS (SELECT * FROM ({_REGION}) v(region, lo, hi)) SELECT region, f.probe_id, "start", "end", status FROM f JOIN r ON lo <= hi AND "start" <= hi AND "end" >= lo""")
def region_features(spark, sf):
    """The probes in several regions of every gene."""
    gene = F.element_at(F.split("probe_id", r"\|"), -1)
    f = stage.keep(features(spark, sf).withColumn("gene_id", gene), "features")
    regions = f.select("gene_id").distinct().join(F.broadcast(spark.createDataFrame([("first", 1, 120), ("inner", 200, 260), ("none", 50, 40), ("far", 300, 10**8)], "region string, lo int, hi int")))
    return intervals.in_regions(f, regions, "gene_id").select("region", "probe_id", "start", "end", "status")


@query(_FEATURES + """ SELECT "start", concat_ws(chr(9), 'ref', 'probe_design', 'probe', "start", "end", '.', '+', '.', 'ID=' || split_part(probe_id, '|', 1) || ';Name=' || split_part(probe_id, '|', 1) || ';risk_level=' || status
|| coalesce(';mismatches=' || mismatches, '') || ';color=' || CASE status WHEN 'high_risk' THEN '#dc2626' WHEN 'medium_risk' THEN '#ea580c' WHEN 'safe' THEN '#10b981' ELSE '#6b7280' END || ';description='
|| CASE WHEN status = 'safe' THEN 'Safe: No off-target alignments' WHEN status = 'high_risk' THEN 'High risk: ' || mismatches || ' mismatch(es)' WHEN mismatches IS NULL THEN 'Medium risk: Failed k-mer safety analysis'
ELSE 'Medium risk: ' || mismatches || ' mismatches' END) AS line FROM f""")
def gff3_lines(spark, sf):
    return report.gff3_lines(features(spark, sf), F.lit("ref"))


@query(_FEATURES + " SELECT count(*) FILTER (status = 'safe') AS safe, count(*) FILTER (status = 'high_risk') AS high_risk, count(*) FILTER (status = 'medium_risk' AND reason = 'kmer') AS medium_kmer, count(*) FILTER (status = 'medium_risk' AND reason = 'mismatch') AS medium_mismatch, count(*) AS total FROM f")
def risk_histogram(spark, sf):
    return report.risk_histogram(features(spark, sf))


# ------------------------------------------------------------------------------------ read queries


@query(f"WITH {B.HITS} SELECT {', '.join(_COLS)} FROM hits ORDER BY probe_id, rname, pos, flag LIMIT 50 OFFSET 50")
def alignments_page(spark, sf):
    return report.page(B.hits(spark, sf), 2, 50).select(*_COLS)


@query(f"WITH {B.HITS} SELECT {', '.join(_COLS)} FROM hits ORDER BY probe_id, rname, pos, flag LIMIT 50 OFFSET 50")
def alignments_stored_page(spark, sf):
    """The same page from the store of sorted parts: the parts that hold it are read, no others."""
    at = stage.path(spark, "alignment-store")
    alignment_store.write(B.hits(spark, sf).select(*_COLS), at)
    return alignment_store.page(spark, at, 2, 50).select(*_COLS)


@query(f"WITH {B.HITS} SELECT count(*) AS n, CAST(ceil(count(*) / 50) AS BIGINT) AS pages FROM hits")
def alignment_pages(spark, sf):
    return report.total_pages(B.hits(spark, sf), 50)


@query(f"WITH {B.HITS} SELECT {', '.join(_COLS)} FROM hits WHERE split_part(probe_id, '|', 1) = (SELECT min(split_part(probe_id, '|', 1)) FROM hits)")
def alignments_for_probe(spark, sf):
    """All alignments of the first probe that has any."""
    h = stage.keep(B.hits(spark, sf), "hits")
    first = h.agg(F.min(I.base_id(F.col("probe_id")))).first()[0]
    return report.of_probe(h, first or "").select(*_COLS)


@query(f"WITH {B.HITS}, {B.GENE_MAP}, s AS (SELECT job, min(rname) AS src, min(gene) AS g FROM hits LEFT JOIN gene_map ON transcript = rname GROUP BY job) SELECT probe_id, flag, rname, pos, nm FROM hits JOIN s USING (job) LEFT JOIN gene_map ON transcript = rname WHERE split_part(rname, '.', 1) <> split_part(src, '.', 1) AND coalesce(gene, rname) IS DISTINCT FROM g")
def off_target_hits(spark, sf):
    """Alignments that are not on the job's own source: its least transcript and its least gene."""
    h = annotate.annotate_genes(stage.keep(B.hits(spark, sf), "hits"), B.gene_map(spark, sf))
    named = h.join(B.gene_map(spark, sf).select(F.col("transcript").alias("rname"), "gene"), "rname", "left")
    sources = named.groupBy("job").agg(F.min("gene").alias("source_gene"), F.array(F.min("rname")).alias("sources"))
    return report.off_target(h, sources).select(*_COLS)


@query(f"WITH {B.HITS} SELECT {', '.join(_COLS)} FROM hits WHERE nm = 1")
def alignments_by_mismatch(spark, sf):
    return report.with_errors(B.hits(spark, sf), 1).select(*_COLS)


@query(f"WITH {B.HITS} SELECT count(*) AS n FROM hits WHERE NOT starts_with(rname, 'src1_')")
def alignment_count(spark, sf):
    h = B.hits(spark, sf).where(~I.same_genome(F.lit("src1"), F.col("rname")))
    return report.count_alignments(h)


_MARK = "array_to_string(list_transform(range(1, 37), lambda i: CASE WHEN substr(seq, i, 1) <> substr(target, i, 1) THEN lower(substr({0}, i, 1)) ELSE substr({0}, i, 1) END), '')"


@query(f"WITH {B.HITS} SELECT probe_id, {_MARK.format('seq')} AS sequence, {_MARK.format('target')} AS target_sequence, rname AS target_transcript, nm AS mismatches, nm AS substitutions, 0 AS bulges, pos AS position, CASE WHEN flag = 16 THEN '-' ELSE '+' END AS strand FROM hits")
def alignment_records(spark, sf):
    return report.records(B.hits(spark, sf))


@query(_ANN + ", c AS (SELECT gene_id AS label, count(*) AS cnt FROM a GROUP BY 1) SELECT label, cnt, round(cnt / sum(cnt) OVER () * 100, 6) AS pct FROM (SELECT * FROM c ORDER BY cnt DESC, label LIMIT 12)")
def offtarget_topn(spark, sf):
    h = stage.keep(_genes_of(spark, sf), "hits")
    best = report.summary(h, I.label(F.col("gene_id"), F.col("rname"))).orderBy(F.desc("cnt"), "label").limit(12)
    total = best.agg(F.sum("cnt").alias("t"))
    return best.crossJoin(F.broadcast(total)).select("label", "cnt", R6(F.col("cnt") / F.col("t") * 100).alias("pct"))


@query(_ANN + """, c AS (SELECT gene_id AS label, count(*) AS cnt FROM a GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY cnt DESC, label) AS r FROM c)
SELECT CASE WHEN r <= 12 THEN label ELSE 'others' END AS label, CAST(sum(cnt) AS BIGINT) AS cnt, round(sum(cnt) / (SELECT sum(cnt) FROM c) * 100, 6) AS pct FROM r GROUP BY 1""")
def offtarget_others(spark, sf):
    return report.summary(stage.keep(_genes_of(spark, sf), "hits"), I.label(F.col("gene_id"), F.col("rname")), 12).withColumn("pct", R6(F.col("pct")))


@query(_ANN + f""", r AS (SELECT probe_id, CASE WHEN min(nm) <= 1 THEN 'high_risk' ELSE 'medium_risk' END AS risk FROM hits GROUP BY 1)
SELECT probe_id, seq AS probe_sequence, printf('%.1f%%', {B.gc('seq')}) AS gc, target AS target_sequence, rname AS target, gene_id AS label, nm AS mismatches, pos, CASE WHEN flag = 16 THEN '-' ELSE '+' END AS strand, risk FROM a JOIN r USING (probe_id) WHERE risk = 'high_risk'""")
def risk_report_tsv(spark, sf):
    h = stage.keep(B.hits(spark, sf), "hits")
    risks = report.regions(B.probes(spark, sf), h).where("risk = 'high_risk'")
    return report.risk_table(annotate.annotate_genes(h, B.gene_map(spark, sf)), risks)


@query(f"""WITH {B.HITS} SELECT probe_id, count(*) AS n, min(nm) AS best, string_agg(nm || ':' || rname || ':' || pos || ':' || flag, ',' ORDER BY nm, rname, pos, flag) AS alignments FROM hits GROUP BY probe_id""")
def grouped_alignments(spark, sf):
    return report.grouped(B.hits(spark, sf))


@query(f"WITH {B.HITS} SELECT DISTINCT nm AS mismatches FROM hits")
def mismatch_options(spark, sf):
    return report.options(B.hits(spark, sf))


@query(
    f"""WITH {B.CANDIDATES}, n AS (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY "start") - 1 AS i FROM candidates)
SELECT 'probe_' || i || '|start=' || "start" || '|end=' || "end" || '|' || gene_id AS probe_id, seq, round({B.tm('seq')}, 2) AS tm, round({B.gc('seq')}, 1) AS gc, CAST(36 AS INTEGER) AS length,
round({B.complexity('seq')}, 3) AS complexity, 'No' AS homopolymer, {B.rc('seq')} AS order_seq FROM n"""
)
def metrics_table(spark, sf):
    """The report's columns but the secondary structure, whose model SQL can't express (secondary_structure has it)."""
    out = report.metrics_table(tiling.with_metrics(tiling.number(B.candidates(spark, sf)))).drop("structure")
    return out.withColumns({c: F.col(c).cast("double") for c in ("tm", "gc", "complexity")})


# ------------------------------------------------------------------------------------ whole designs


_RUN = f"""WITH {B.COUNTS}, n AS (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY "start") - 1 AS i FROM candidates),
p AS (SELECT 'probe_' || i || '|start=' || "start" || '|end=' || "end" || '|' || gene_id AS id, gene_id AS job, "start", seq FROM n),
q AS (SELECT id, job, 0 AS flag, seq FROM p UNION ALL SELECT id, job, 16, {B.rc('seq')} FROM p),
seeds AS (SELECT id, job, flag, seq, CAST(j * {B.SEED} AS INTEGER) AS off, substr(seq, CAST(j * {B.SEED} + 1 AS INTEGER), {B.SEED}) AS seed FROM q, range({B.ERRORS + 1}) t(j)),
ref AS (SELECT contig, p, substr(seq, p, {B.SEED}) AS seed FROM (SELECT contig, seq, unnest(range(1, length(seq) - {B.SEED - 2})) AS p FROM contigs)),
cand AS (SELECT DISTINCT id, job, flag, seeds.seq, contig, p - off AS pos FROM ref JOIN seeds USING (seed) WHERE p > off),
hit AS (SELECT id, job, flag, contig AS rname, pos, hamming(cand.seq, substr(c.seq, pos, 36)) AS nm FROM cand JOIN contigs c USING (contig)
  WHERE length(substr(c.seq, pos, 36)) = 36 AND hamming(cand.seq, substr(c.seq, pos, 36)) <= {B.ERRORS})"""


@query(_RUN + """, b AS (SELECT job, rname, id, min(nm) AS nm FROM hit GROUP BY ALL), per AS (SELECT job, rname, count(*) FILTER (nm = 0) AS perfect, count(*) AS every FROM b GROUP BY ALL),
best AS (SELECT job, max(perfect) > 0 AS ok FROM per GROUP BY job),
top AS (SELECT job, rname AS top FROM (SELECT per.job, rname, row_number() OVER (PARTITION BY per.job ORDER BY CASE WHEN ok THEN perfect END DESC, every DESC, rname) AS r FROM per JOIN best USING (job)) WHERE r = 1),
st AS (SELECT id, CASE WHEN bool_and(rname = top) THEN 'safe' ELSE 'risk' END AS status FROM hit JOIN top USING (job) GROUP BY id),
chosen AS (SELECT p.*, status FROM p LEFT JOIN st USING (id) WHERE status IS NULL OR status = 'safe'),
tot AS (SELECT ckmer, sum(cnt) AS n FROM counts GROUP BY ckmer),
own AS (SELECT job, ckmer, sum(cnt) AS n FROM top JOIN counts ON genome = split_part(top, '_', 1) GROUP BY job, ckmer),
bad AS (SELECT DISTINCT chosen.id FROM kmers JOIN chosen ON kmers.gene_id = chosen.job AND kmers."start" = chosen."start" JOIN tot USING (ckmer) LEFT JOIN own ON own.job = chosen.job AND own.ckmer = kmers.ckmer WHERE tot.n > coalesce(own.n, 0))
SELECT id AS probe_id, seq, status FROM chosen WHERE id NOT IN (SELECT id FROM bad)""")
def design_microbiome(spark, sf):
    """Gene input against catalogs: sources are inferred from the alignments, their genomes' own k-mers are excused."""
    return design.of_genes(B.genes(spark, sf), B.contigs(spark, sf), design.Options(is_microbiome=True), species=B.species_map(spark, sf)).safe.select("probe_id", "seq", "status")


@query()
def design_host_internal(spark, sf):
    return design.of_genes(B.genes(spark, sf), B.contigs(spark, sf), design.Options(host_internal=True), gene_map=B.gene_map(spark, sf)).features


_DESIGN = f"""WITH {B.COUNTS}, bad AS (SELECT DISTINCT gene_id, "start" FROM kmers WHERE ckmer IN (SELECT ckmer FROM counts)),
p AS (SELECT gene_id || '_' || "start" AS id, seq FROM candidates),
q AS (SELECT id, 0 AS flag, seq FROM p UNION ALL SELECT id, 16, {B.rc('seq')} FROM p),
seeds AS (SELECT id, flag, seq, CAST(j * {B.SEED} AS INTEGER) AS off, substr(seq, CAST(j * {B.SEED} + 1 AS INTEGER), {B.SEED}) AS seed FROM q, range({B.ERRORS + 1}) t(j)),
ref AS (SELECT contig, p, substr(seq, p, {B.SEED}) AS seed FROM (SELECT contig, seq, unnest(range(1, length(seq) - {B.SEED - 2})) AS p FROM contigs)),
cand AS (SELECT DISTINCT id, flag, seeds.seq, contig, p - off AS pos FROM ref JOIN seeds USING (seed) WHERE p > off),
hit AS (SELECT DISTINCT id FROM cand JOIN contigs c USING (contig) WHERE length(substr(c.seq, pos, 36)) = 36 AND hamming(cand.seq, substr(c.seq, pos, 36)) <= {B.ERRORS})
SELECT gene_id, "start", seq FROM candidates WHERE gene_id || '_' || "start" NOT IN (SELECT id FROM hit)
  AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.gene_id = candidates.gene_id AND bad."start" = candidates."start")"""


@query(_DESIGN)
def design_microbe_mode(spark, sf):
    """Gene input whose every alignment is off target: only probes without alignments and without shared k-mers are safe."""
    d = design.of_genes(B.genes(spark, sf), B.contigs(spark, sf), design.Options(microbe_mode=True))
    return d.safe.where("status IS NULL").select("gene_id", "start", "seq")


@query(_RUN + f""", bad AS (SELECT DISTINCT gene_id, "start" FROM kmers SEMI JOIN counts USING (ckmer)),
fun AS (SELECT {B.gc('seq')} BETWEEN 40 AND 80 AS g, {B.tm('seq')} BETWEEN 42 AND 47 AS t, {B.homopolymer('seq')} AS h FROM windows),
free AS (SELECT * FROM p WHERE id NOT IN (SELECT id FROM hit))
SELECT 'candidates' AS stage, count(*) AS n FROM p UNION ALL SELECT 'raw_alignments', count(*) FROM hit UNION ALL SELECT 'filtered_alignments', count(*) FROM hit UNION ALL SELECT 'aligned_probes', count(DISTINCT id) FROM hit
UNION ALL SELECT 'self_safe', 0 UNION ALL SELECT 'on_target', count(*) FROM free UNION ALL SELECT 'safe', count(*) FROM free WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.gene_id = free.job AND bad."start" = free."start")
UNION ALL SELECT 'windows', count(*) FROM fun UNION ALL SELECT 'gc_pass', count(*) FROM fun WHERE g UNION ALL SELECT 'gc_reject', count(*) FROM fun WHERE NOT g UNION ALL SELECT 'tm_reject', count(*) FROM fun WHERE g AND NOT t
UNION ALL SELECT 'homopolymer_reject', count(*) FROM fun WHERE g AND t AND h""")
def design_stats(spark, sf):
    return design.of_genes(B.genes(spark, sf), B.contigs(spark, sf), design.Options(microbe_mode=True)).stats
