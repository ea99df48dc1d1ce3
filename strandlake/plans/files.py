"""Registered queries of the text formats: relations derived from the tables are written as files and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seq as S
from ..operators import align, annotate, classify, kmers, report, tiling
from ..sources import annotation, fasta, kmer_store, pieces, reports, sam, stage
from . import base as B
from .registry import query


def _text(df: DataFrame, name: str) -> str:
    """Write a column `line` as text files."""
    at = stage.path(df.sparkSession, name)
    df.select("line").write.text(at)
    return at


def _sam(spark, hits: DataFrame) -> DataFrame:
    return sam.read(spark, _text(report.sam_lines(hits), "sam"))


_SAM = "SELECT probe_id, flag, rname, {gene} AS gene_id, pos, '36M' AS cigar, seq, nm, {md} AS md, {species} AS species FROM {{0}}"


@query(f"WITH {B.HITS} " + _SAM.format(gene="CAST(NULL AS VARCHAR)", md=B.md(), species="CAST(NULL AS VARCHAR)").format("hits"))
def sam_plain(spark, sf):
    return _sam(spark, B.hits(spark, sf)).drop("line")


@query(f"WITH {B.HITS}, {B.GENE_MAP} " + _SAM.format(gene="coalesce(gene, rname)", md=B.md(), species="CAST(NULL AS VARCHAR)").format("hits LEFT JOIN gene_map ON transcript = rname"))
def sam_with_genes(spark, sf):
    return _sam(spark, annotate.annotate_genes(B.hits(spark, sf), B.gene_map(spark, sf))).drop("line")


@query(f"WITH {B.HITS}, {B.SPECIES_MAP} " + _SAM.format(gene="CAST(NULL AS VARCHAR)", md=B.md(), species="coalesce(species, 'Unknown')").format("hits LEFT JOIN species_map ON genome = split_part(rname, '_', 1)"))
def sam_with_species(spark, sf):
    return _sam(spark, annotate.annotate_species(B.hits(spark, sf), B.species_map(spark, sf))).drop("line")


@query(f"""WITH {B.HITS}, r AS (SELECT probe_id, flag, rname, pos, first_value(seq) OVER (PARTITION BY probe_id ORDER BY rname, pos, flag) AS seq FROM hits)
SELECT probe_id, flag, rname, pos, seq FROM r UNION ALL SELECT probe_id, 4, '*', 0, seq FROM probes WHERE probe_id NOT IN (SELECT probe_id FROM hits)""")
def sam_carried(spark, sf):
    """SAM in which only a probe's first line has its sequence, and unaligned probes lie on '*'."""
    hits = stage.keep(B.hits(spark, sf), "hits")
    first = F.row_number().over(Window.partitionBy("probe_id").orderBy("rname", "pos", "flag"))
    short = hits.withColumn("_n", first).withColumn("seq", F.when(F.col("_n") == 1, F.col("seq")).otherwise("*"))
    none = B.probes(spark, sf).join(hits, "probe_id", "left_anti").select("probe_id", F.lit(4).alias("flag"), F.lit("*").alias("rname"), F.lit(0).alias("pos"), F.lit("*").alias("cigar"), F.lit(None).cast("int").alias("nm"), F.lit(None).cast("string").alias("md"), "seq", F.lit(1).alias("_n"))
    both = short.select("probe_id", "flag", "rname", "pos", "cigar", "nm", "md", "seq", "_n").unionByName(none)
    tags = F.when(F.col("nm").isNotNull(), F.concat(F.lit("\tNM:i:"), F.col("nm").cast("string"), F.lit("\tMD:Z:"), "md")).otherwise("")
    line = F.concat(F.concat_ws("\t", "probe_id", F.col("flag").cast("string"), "rname", F.col("pos").cast("string"), F.lit("255"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), "seq", F.repeat(F.lit("I"), F.lit(36))), tags)
    in_order = both.select("probe_id", "_n", line.alias("line")).repartition("probe_id").sortWithinPartitions("probe_id", "_n")
    return sam.read(spark, _text(in_order, "sam")).select("probe_id", "flag", "rname", "pos", "seq")


@query(f"WITH {B.HITS} SELECT probe_id AS seq_id, seq FROM probes WHERE probe_id NOT IN (SELECT probe_id FROM hits)")
def fasta_on_target(spark, sf):
    """Probes without any alignment, as FASTA."""
    p = B.probes(spark, sf)
    statuses = classify.classify(B.hits(spark, sf).withColumn("gene_id", F.col("rname")), is_probe_input=True)
    at = stage.path(spark, "fasta")
    fasta.write(classify.on_target(p, statuses), at)
    return fasta.read(spark, at, "part-*").select("seq_id", "seq")


@query(f"WITH {B.HITS} SELECT probe_id, count(*) AS lines, min(nm) AS best FROM (SELECT * FROM hits UNION ALL SELECT * FROM hits WHERE nm = 0) GROUP BY probe_id")
def sam_merged(spark, sf):
    """Two parts with their headers, as one."""
    lines = report.sam_lines(stage.keep(B.hits(spark, sf), "hits"))
    head = spark.createDataFrame([("@HD\tVN:1.4\tSO:unsorted",)], "line string")
    first, second = head.union(lines), head.union(lines.where("line LIKE '%\tNM:i:0\t%'"))
    merged = sam.read(spark, _text(sam.merge([first, second]), "sam"))
    return merged.groupBy("probe_id").agg(F.count("*").alias("lines"), F.min("nm").alias("best"))


@query(f"WITH {B.CONTIGS} SELECT contig, genome, 'all' AS grp, CAST(length(seq) AS INTEGER) AS n_bases, md5(seq) AS digest FROM contigs WHERE seq <> ''")
def fasta_contigs(spark, sf):
    at = stage.path(spark, "fasta")
    fasta.write(B.contigs(spark, sf).where("seq <> ''"), at, name="contig", width=80)
    found = fasta.contigs(spark, {"all": at}, glob="part-*")
    return found.select("contig", "genome", "grp", F.length("seq").alias("n_bases"), F.md5("seq").alias("digest"))


def _in_pieces(spark, sf) -> DataFrame:
    """The contigs as FASTA, read in small pieces."""
    at = stage.path(spark, "fasta")
    fasta.write(B.contigs(spark, sf).where("seq <> ''"), at, name="contig", width=80)
    return pieces.contigs(spark, {"all": at}, overlap=B.LENGTH + 2, piece=5000, glob="part-*")


@query(f"WITH {B.CONTIGS} SELECT contig, genome, 'all' AS grp, CAST(length(seq) AS BIGINT) AS n_bases, md5(seq) AS digest FROM contigs WHERE seq <> ''")
def fasta_pieces(spark, sf):
    """The pieces of every record, put together again."""
    own = F.struct("at", F.substr("seq", F.lit(1), F.col("own")).alias("seq"))
    per = _in_pieces(spark, sf).groupBy("contig", "genome", "grp").agg(F.sum("own").alias("n_bases"), F.array_sort(F.collect_list(own)).alias("p"))
    return per.select("contig", "genome", "grp", "n_bases", F.md5(F.array_join("p.seq", "")).alias("digest"))


@query(f"WITH {B.HITS} SELECT probe_id, flag, rname, pos, nm, target FROM hits")
def align_pieces(spark, sf):
    """Alignments with a reference in pieces: none is lost or doubled at their borders."""
    return align.align_ungapped(B.probes(spark, sf), _in_pieces(spark, sf), B.ERRORS).select("probe_id", "flag", "rname", "pos", "nm", "target")


@query(f"WITH {B.CONTIGS}, r AS (SELECT contig AS name, seq, unnest([[1, 50], [length(seq) // 2, length(seq) // 2 + 200], [length(seq) - 9, length(seq) + 100], [length(seq) + 1, length(seq) + 5]]) AS r FROM contigs WHERE seq <> '') "
       "SELECT name, CAST(r[1] AS BIGINT) AS lo, CAST(r[2] AS BIGINT) AS hi, substr(seq, CAST(greatest(r[1], 1) AS INTEGER), CAST(greatest(r[2] - greatest(r[1], 1) + 1, 0) AS INTEGER)) AS seq FROM r")
def fasta_fetch(spark, sf):
    """Regions of an indexed FASTA of many records, read by ranges of bytes."""
    c = B.contigs(spark, sf).where("seq <> ''")
    index = fasta.write_indexed(c, stage.path(spark, "indexed-fasta"), name="contig")
    n = F.length("seq")
    ends = [(F.lit(1), F.lit(50)), (F.floor(n / 2), F.floor(n / 2) + 200), (n - 9, n + 100), (n + 1, n + 5)]
    regions = c.select(F.col("contig").alias("name"), F.explode(F.array(*[F.struct(a.cast("long").alias("lo"), b.cast("long").alias("hi")) for a, b in ends])).alias("r"))
    return fasta.fetch(index, regions.select("name", "r.lo", "r.hi"))


@query(f"WITH {B.PLACED} SELECT probe_id, flag, rname, pos, {B.PLACED_CIGAR} AS cigar, q AS seq, nm, {B.PLACED_MD} AS md FROM lined")
def sam_gapped(spark, sf):
    """Gapped alignments as SAM."""
    hits = align.align_gapped(B.bulged(spark, sf), B.contigs(spark, sf), B.ERRORS, 1)
    return _sam(spark, hits).select("probe_id", "flag", "rname", "pos", "cigar", "seq", "nm", "md")


@query(f"WITH {B.CANDIDATES} SELECT gene_id || '_' || \"start\" AS seq_id, seq FROM candidates")
def fasta_probes(spark, sf):
    at = stage.path(spark, "fasta")
    named = B.candidates(spark, sf).select(F.concat_ws("_", "gene_id", F.col("start").cast("string")).alias("probe_id"), "seq")
    fasta.write(named, at, order=["probe_id"])
    return fasta.read(spark, at, "part-*").select("seq_id", "seq")


@query(f"WITH {B.CONTIGS}, {B.GENE_MAP} SELECT transcript, gene FROM gene_map")
def gtf_genes(spark, sf):
    m = B.gene_map(spark, sf)
    line = F.concat_ws("\t", F.lit("1"), F.lit("x"), F.lit("transcript"), F.lit("1"), F.lit("9"), F.lit("."), F.lit("+"), F.lit("."), F.format_string('gene_id "i"; transcript_id "%s"; gene_name "%s";', "transcript", "gene"))
    return annotation.gtf_genes(spark, _text(m.select(line.alias("line")), "gtf"))


@query(f"WITH {B.CONTIGS}, {B.GENE_MAP} SELECT transcript, CASE WHEN gene IN ('G7', 'G11') THEN 'id' || gene ELSE gene END AS gene FROM gene_map")
def gff3_genes(spark, sf):
    """Two genes have no name, so that their ids stand for them."""
    m = B.gene_map(spark, sf)
    row = lambda kind, attrs: F.concat_ws("\t", F.lit("1"), F.lit("x"), F.lit(kind), F.lit("1"), F.lit("9"), F.lit("."), F.lit("+"), F.lit("."), attrs)
    gene = m.select("gene").distinct().select(row("gene", F.concat(F.lit("ID=gene:id"), "gene", F.when(F.col("gene").isin("G7", "G11"), "").otherwise(F.concat(F.lit(";Name="), "gene")))).alias("line"))
    made = m.select(row("mRNA", F.format_string("ID=transcript:%s;Parent=gene:id%s", "transcript", "gene")).alias("line"))
    return annotation.gff3_genes(spark, _text(gene.union(made), "gff3"))


@query(f"WITH {B.SPECIES_MAP} SELECT genome, species FROM species_map WHERE species <> ''")
def metadata_species(spark, sf):
    m = B.species_map(spark, sf).where("species <> ''")
    head = spark.createDataFrame([("\t".join(f"c{i}" for i in range(15)),)], "line string")
    rows = m.select(F.concat_ws("\t", "genome", *[F.lit("x")] * 13, F.concat(F.lit("d__B;s__"), "species")).alias("line"))
    return annotation.genome_species(spark, _text(head.union(rows), "metadata"))


@query("SELECT source || '_' || doc_id AS accession, 'S' || (doc_id % 50) AS symbol, lang AS species FROM documents WHERE lang IS NOT NULL")
def refseq_symbols(spark, sf):
    """Every accession has a second, later line, which doesn't count; each file begins with a header."""
    d = B.table(spark, sf, "documents").where("lang IS NOT NULL")
    line = lambda word: F.concat_ws("\t", F.concat_ws("_", "source", F.col("doc_id").cast("string")), F.concat(F.lit(word), (F.col("doc_id") % 50).cast("string")), "lang")
    at = stage.path(spark, "refseq")
    lines = d.select(F.explode(F.array(line("S"), line("later"))).alias("value"))
    lines.write.option("header", True).option("sep", "\x01").option("quote", "\x00").csv(at)
    return annotation.refseq(spark, at, header="value")


_FEATURES = f"""WITH {B.HITS}, {B.SCREEN}, m AS (SELECT probe_id, min(nm) AS mm FROM hits GROUP BY 1), f AS (SELECT split_part(probes.probe_id, '|', 1) AS probe_id,
  CASE WHEN mm IS NULL THEN CASE WHEN screened.probe_id IS NULL THEN 'medium_risk' ELSE 'safe' END WHEN mm <= 1 THEN 'high_risk' ELSE 'medium_risk' END AS risk, mm AS mismatches
  FROM probes LEFT JOIN m USING (probe_id) LEFT JOIN screened ON screened.probe_id = probes.probe_id)"""


@query(_FEATURES + """ SELECT probe_id, risk, mismatches, CASE WHEN risk = 'safe' THEN 'Safe: No off-target alignments' WHEN risk = 'high_risk' THEN 'High risk: ' || mismatches || ' mismatch(es)'
WHEN mismatches IS NULL THEN 'Medium risk: Failed k-mer safety analysis' ELSE 'Medium risk: ' || mismatches || ' mismatches' END AS description FROM f""")
def gff3_probes(spark, sf):
    from .queries import features

    at = stage.path(spark, "gff3")
    reports.write_gff3(report.gff3_lines(features(spark, sf), F.lit("ref")), at, "ref", 100_000)
    return reports.risks_of(reports.read_gff3(spark, at))


@query(
    f"""WITH {B.CANDIDATES}, n AS (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY "start") - 1 AS i FROM candidates)
SELECT 'probe_' || i || '|start=' || "start" || '|end=' || "end" || '|' || gene_id AS probe_id, 'probe_' || i AS name, seq, CAST(36 AS INTEGER) AS length, 'No' AS homopolymer, {B.rc('seq')} AS order_seq,
abs(tm - {B.tm('seq')}) < 0.00501 AS tm_ok, abs(gc - {B.gc('seq')}) < 0.0501 AS gc_ok, abs(complexity - {B.complexity('seq')}) < 0.000501 AS complexity_ok
FROM (SELECT *, {B.tm('seq')} AS tm, {B.gc('seq')} AS gc, {B.complexity('seq')} AS complexity FROM n)"""
)
def metrics_report(spark, sf):
    at = stage.path(spark, "metrics")
    reports.write_metrics(report.metrics_table(tiling.with_metrics(tiling.number(B.candidates(spark, sf)))), at)
    m, s = reports.read_metrics(spark, at), F.col("seq")
    near = lambda c, v, d: (F.abs(F.col(c) - v) < d).alias(f"{c}_ok")
    return m.select("probe_id", "name", "seq", "length", "homopolymer", "order_seq", near("tm", S.tm_nn(s), 0.00501), near("gc", S.gc_percent(s), 0.0501), near("complexity", S.complexity(s), 0.000501))


@query(f"WITH {B.COUNTS} SELECT grp, ckmer, CAST(sum(cnt) AS BIGINT) AS cnt FROM counts WHERE grp IS NOT NULL GROUP BY grp, ckmer")
def kmer_database(spark, sf):
    """The whole reference's database: one language first, then what it lacks, then nothing; asked for the candidates' k-mers."""
    at = stage.path(spark, "kmers")
    ref = B.contigs(spark, sf).where("grp IS NOT NULL")
    for part in (ref.where("grp = 'en'"), ref, ref):
        kmer_store.build(part, [B.K], at)
    wanted = kmers.explode_kmers(B.candidates(spark, sf), B.K, ("gene_id", "start"))
    return kmer_store.lookup(spark, at, wanted, B.K)
