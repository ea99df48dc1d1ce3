"""Annotation of alignments: genes, species, gene groups, host tokens, source of a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids as I


def first_wins(table: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the first by `order`, in one aggregation."""
    rest = [c for c in table.columns if c != key]
    best = table.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def lookup(df: DataFrame, table: DataFrame, column: str, out: str, versionless: bool = True) -> DataFrame:
    """Adds `out`: the table's value (key, value) for a column, by exact key or else by the key without version; null if neither.

    Spark chooses the join by the table's size.
    """
    exact = table.select(F.col("key").alias("_k1"), F.col("value").alias("_v1"))
    df = df.join(exact, F.col(column) == F.col("_k1"), "left")
    found = F.col("_v1")
    if versionless:
        bare = table.groupBy(I.strip_version(F.col("key")).alias("_k2")).agg(F.min("value").alias("_v2"))
        df = df.join(bare, I.strip_version(F.col(column)) == F.col("_k2"), "left")
        found = F.coalesce("_v1", "_v2")
    return df.withColumn(out, found).drop("_k1", "_v1", "_k2", "_v2")


def annotate_genes(hits: DataFrame, genes: DataFrame) -> DataFrame:
    """Adds gene_id: the transcript's gene (transcript, gene), the transcript itself where it has none."""
    out = lookup(hits, genes.select(F.col("transcript").alias("key"), F.col("gene").alias("value")), "rname", "gene_id", versionless=False)
    return out.withColumn("gene_id", F.coalesce("gene_id", "rname"))


def annotate_species(hits: DataFrame, species: DataFrame, genes: DataFrame | None = None, prefixes: DataFrame | None = None) -> DataFrame:
    """Adds species by the contig's genome (genome, species); for ids with a host's prefix (prefix, host) the transcript's gene; else Unknown."""
    table = species.select(F.col("genome").alias("_g"), F.col("species").alias("_s"))
    out = hits.join(table, I.genome_of(F.col("rname")) == F.col("_g"), "left")
    found = F.col("_s")
    if genes is not None and prefixes is not None:
        out = host_of(out, prefixes, "rname", "_host")
        out = lookup(out, genes.select(F.col("transcript").alias("key"), F.col("gene").alias("value")), "rname", "_gene")
        found = F.coalesce(F.when(F.col("_host").isNotNull(), F.col("_gene")), "_s")
    return out.withColumn("species", F.coalesce(found, F.lit("Unknown"))).drop("_g", "_s", "_host", "_gene")


def host_of(df: DataFrame, prefixes: DataFrame, column: str, out: str) -> DataFrame:
    """Adds `out`: the host (prefix, host) with the longest prefix of an id, as a single expression over the registry's few prefixes."""
    rows = sorted(((r["prefix"], r["host"]) for r in prefixes.select("prefix", "host").collect()), key=lambda x: (-len(x[0]), x))  # the registry is configuration
    found = F.lit(None).cast("string")
    for prefix, host in reversed(rows):
        found = F.when(F.startswith(F.col(column), F.lit(prefix)), F.lit(host)).otherwise(found)
    return df.withColumn(out, found)


def gene_groups(hits: DataFrame, genes: DataFrame) -> DataFrame:
    """Adds grp: the gene by exact id, else without version, else the id without version."""
    out = lookup(hits, genes.select(F.col("transcript").alias("key"), F.col("gene").alias("value")), "rname", "grp")
    return out.withColumn("grp", F.coalesce("grp", I.strip_version(F.col("rname"))))


def tokens(headers: DataFrame, key: str = "gene_id", header: str = "header") -> DataFrame:
    """key, rank, name: each header's candidate names in the order in which they are tried."""
    t = headers.select(key, F.posexplode(I.header_tokens(F.col(header))).alias("i", "token"))
    c = t.select(key, "i", F.posexplode(I.token_candidates(F.col("token"))).alias("j", "name"))
    return c.select(key, (F.col("i") * 1000 + F.col("j")).alias("rank"), "name")


def source_of_header(headers: DataFrame, transcripts: DataFrame, refseq: DataFrame | None = None, key: str = "gene_id", header: str = "header") -> DataFrame:
    """key, source_gene, sources: the first name of a header that is a transcript, a gene symbol or a RefSeq accession of one, and all of that gene's transcripts.

    transcripts: transcript, gene. refseq: accession, symbol. A transcript wins over a gene, a gene over RefSeq, for the same name.
    """
    by_name = transcripts.select(F.col("transcript").alias("name"), F.lit(0).alias("kind"), "gene")
    by_name = by_name.union(transcripts.select(I.strip_version(F.col("transcript")), F.lit(1), "gene"))
    by_name = by_name.union(transcripts.select(F.col("gene"), F.lit(2), "gene").distinct())
    if refseq is not None:
        by_name = by_name.union(refseq.select("accession", F.lit(3), "symbol").join(transcripts.select(F.col("gene").alias("symbol")).distinct(), "symbol", "left_semi").select("accession", F.lit(3), "symbol"))
    hit = tokens(headers, key, header).join(by_name, "name").groupBy(key).agg(F.min(F.struct("rank", "kind", "gene")).alias("m"))
    hit = hit.select(key, F.col("m.gene").alias("source_gene"))
    return hit.join(transcripts.select(F.col("gene").alias("source_gene"), "transcript"), "source_gene").groupBy(key, "source_gene").agg(F.sort_array(F.collect_set("transcript")).alias("sources"))


def host_tokens(headers: DataFrame, table: DataFrame, species: list[str], key: str = "gene_id", header: str = "header") -> DataFrame:
    """key, kind, token, species: what in a header names a host; each once.

    table: name, kind, species. A species name in the header counts as kind 'binomial'.
    """
    t = headers.select(key, F.posexplode(I.header_tokens(F.col(header))).alias("i", "token"))
    c = t.select(key, "i", "token", F.posexplode(I.token_candidates(F.col("token"))).alias("j", "name"))
    first = c.join(table, "name").groupBy(key, "i", "token").agg(F.min(F.struct("j", "kind", "species")).alias("m"))
    named = first.select(key, F.col("m.kind").alias("kind"), "token", F.col("m.species").alias("species"))
    found = I.binomial(F.col(header), species)
    spoken = headers.select(key, F.lit("binomial").alias("kind"), found.alias("token")).where("token <> ''")
    spoken = spoken.withColumn("species", F.concat(F.upper(F.substring("token", 1, 1)), F.lower(F.regexp_replace(F.substr("token", F.lit(2)), r"\s+", " "))))
    return named.union(spoken).dropDuplicates([key, "kind", "token", "species"])


def verdict(found: DataFrame, key: str = "gene_id", wanted: str | None = None, is_microbiome: bool = False, hosts: tuple[str, ...] = ()) -> DataFrame:
    """key, verdict: what the detected host tokens mean for a job on the species `wanted`."""
    per = found.groupBy(key).agg(F.count_distinct("species").alias("n"), F.max("species").alias("one"))
    if is_microbiome:
        v = F.lit("allow")
    elif not wanted or wanted not in hosts:
        v = F.lit("block")
    else:
        v = F.when(F.col("n") > 1, "block").when(F.col("one") != wanted, "block").otherwise("host_internal")
    return per.select(key, v.alias("verdict"))


def top_of(df: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
