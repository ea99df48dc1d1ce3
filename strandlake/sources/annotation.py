"""Gene annotation and metadata tables: GTF, GFF3, catalog metadata, RefSeq; the release-keyed cache."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Feature types that count as transcripts.
TRANSCRIPTS = ("mRNA", "transcript", "lnc_RNA", "ncRNA", "snRNA", "snoRNA", "rRNA", "tRNA", "miRNA", "pseudogenic_transcript")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """value, at: lines without comments, with an order within the input."""
    return spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at")).where("value NOT LIKE '#%' AND value <> ''")


def gtf_genes(spark: SparkSession, path: str) -> DataFrame:
    """transcript, gene; a transcript's last line wins."""
    pick = lambda name: F.regexp_extract("value", rf'{name} "([^"]+)"', 1)
    rows = _lines(spark, path).select(pick("transcript_id").alias("transcript"), pick("gene_name").alias("gene"), "at").where("transcript <> '' AND gene <> ''")
    return rows.groupBy("transcript").agg(F.max_by("gene", "at").alias("gene"))


def gff3_genes(spark: SparkSession, path: str) -> DataFrame:
    """transcript, gene: a transcript's parent gene by name, by id where the gene has none."""
    cols = F.split("value", "\t")
    attr = lambda name: F.regexp_extract(cols[8], rf"(?:^|;){name}=([^;]+)", 1)
    rows = _lines(spark, path).where(F.size(cols) >= 9).select(cols[2].alias("type"), attr("ID").alias("id"), attr("Parent").alias("parent"), attr("Name").alias("name"), "at")
    bare = lambda c: F.regexp_replace(c, r"^(gene|transcript|rna)[:-]", "")
    genes = rows.where("type = 'gene' AND id <> ''").groupBy("id").agg(F.max_by(F.when(F.col("name") == "", bare(F.col("id"))).otherwise(F.col("name")), "at").alias("gene"))
    made = rows.where(F.col("type").isin(*TRANSCRIPTS) & (F.col("id") != "") & (F.col("parent") != ""))
    made = made.groupBy("id").agg(F.max_by("parent", "at").alias("parent"))
    out = made.join(genes.withColumnRenamed("id", "parent"), "parent", "left")
    return out.select(bare(F.col("id")).alias("transcript"), F.coalesce("gene", bare(F.col("parent"))).alias("gene"))


def genome_species(spark: SparkSession, path: str) -> DataFrame:
    """genome, species of a catalog's metadata table (a header line, tabs, lineage in the 15th column)."""
    cols = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(cols) >= 15).select(cols[0].alias("genome"), F.regexp_extract(cols[14], "s__([^;]+)", 1).alias("species"))
    return rows.where("species <> ''")


def refseq(spark: SparkSession, path: str, header: str = "accession") -> DataFrame:
    """accession, symbol, species (null if there is none): tabs; lines that begin with the header's first word are headers, one in each file; of lines
    with an accession and a symbol, an accession's first counts, by file name and place in the file."""
    cols = F.split("value", "\t")
    order = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    rows = spark.read.text(path).select(order.alias("at"), cols.alias("c")).where((F.size("c") >= 2) & (F.col("c")[0] != "") & (F.col("c")[1] != ""))
    rows = rows.where(F.lower(F.ltrim(F.col("c")[0], F.lit("#"))) != header.lower())
    first = rows.groupBy(F.col("c")[0].alias("accession")).agg(F.min_by("c", "at").alias("c"))
    return first.select("accession", F.col("c")[1].alias("symbol"), F.get("c", F.lit(2)).alias("species"))


def latest_release(names: list[str], pattern: str) -> int | None:
    """The highest release number among file names; the pattern's first group is the number."""
    found = [int(m[1]) for n in names if (m := re.search(pattern, n))]
    return max(found, default=None)


def cached_genes(spark: SparkSession, read, release: int, folder: str) -> DataFrame:
    """The mapping of a release, kept as Parquet under its number; `read` makes it where it isn't there yet."""
    path = f"{folder}/release={release}"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        read().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def check_host(names: list[str], chunks: list[str], pattern: str) -> int:
    """The release of a host whose genome file and reference chunks are there; raises ValueError that says what is missing."""
    release = latest_release(names, pattern)
    if release is None:
        raise ValueError("no genome file matches the host's pattern")
    if not any(c.endswith((".fa", ".fna", ".fa.gz", ".fna.gz")) for c in chunks):
        raise ValueError("the host has no reference chunks")
    return release
