"""Canonical k-mer counts of a reference and the k-mer safety of probes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions import seq as S
from . import scan


def explode_kmers(probes: DataFrame, k: int, key: tuple[str, ...] = ("probe_id",)) -> DataFrame:
    """key, at (from 1), kmer, ckmer (canonical): every position of every probe; k-mers with other letters are left out."""
    w = probes.select(*key, F.explode(S.windows(F.col("seq"), k)).alias("w"))
    out = w.select(*key, F.col("w.start").alias("at"), F.col("w.window").alias("kmer"))
    return out.where(~F.rlike("kmer", F.lit("[^ACGT]"))).withColumn("ckmer", S.canonical(F.col("kmer")))


def code(kmer: Column, k: int) -> Column:
    """2-bit code of a k-mer of ACGT (k <= 31)."""
    digits = F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10)
    return digits.cast("long")


def canonical_codes(codes: np.ndarray, k: int) -> np.ndarray:
    """Canonical 2-bit codes of the windows of ACGT in base codes."""
    w, ok = scan.window_codes(codes, k)
    w = w[ok]
    return np.minimum(w, scan.revcomp_codes(w, k))


def counter(k: int, wanted, keys: int):
    """Partial counts of each batch by its leading key columns: of the wanted codes, or of all k-mers where none are given. They leave the task a piece's worth at a time, however long the batch's sequences are."""

    def run(batches):
        table = wanted.value if wanted is not None else None
        for batch in batches:
            rows, found, held = [], [], 0

            def part():
                code, n = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
                at = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
                return pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(keys)), pa.array(code), pa.array(n)], names=[*batch.schema.names[:keys], "code", "n"])

            for i in range(batch.num_rows):
                for _, codes in scan.pieces(scan.encode((batch.column(keys)[i].as_py() or "").encode()), k - 1):
                    w = canonical_codes(codes, k)
                    if table is not None:
                        w = w[scan.found_in(w, table) >= 0]
                    w, n = np.unique(w, return_counts=True)
                    rows.append(np.full(len(w), i))
                    found.append((w, n))
                    held += len(w)
                    if held >= scan.PIECE:
                        yield part()
                        rows, found, held = [], [], 0
            yield part()

    return run


def own_bases(contigs: DataFrame, k: int) -> DataFrame:
    """Contigs in pieces (see sources/pieces.py) without the k-mers that the next piece has; whole contigs as they are."""
    return contigs.withColumn("seq", F.substr("seq", F.lit(1), F.col("own") + k - 1)) if "own" in contigs.columns else contigs


def count_kmers(contigs: DataFrame, kmers: DataFrame, k: int, by: tuple[str, ...] = ("grp",), block: int = scan.BLOCK) -> DataFrame:
    """by..., ckmer, cnt: how often each wanted canonical k-mer (column ckmer of kmers) occurs in the contigs.

    Up to `block` wanted k-mers are broadcast, and each task counts those it meets; beyond, tasks count all k-mers, and a join keeps the
    wanted ones. Either way Spark adds the partial counts up by group and k-mer.
    """
    rows = own_bases(contigs, k).select(*by, "seq")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + ["code long", "n long"])
    few = wanted_codes(kmers, k, block)
    table = contigs.sparkSession.sparkContext.broadcast(few) if few is not None else None
    return summed(rows.mapInArrow(counter(k, table, len(by)), schema), kmers, k, by)


def _wanted(kmers: DataFrame, k: int) -> DataFrame:
    if k > 31:
        raise ValueError("k must be at most 31")
    return kmers.select("ckmer").distinct().select("ckmer", code(F.col("ckmer"), k).alias("code"))


def wanted_codes(kmers: DataFrame, k: int, block: int = scan.BLOCK) -> np.ndarray | None:
    """The wanted k-mers' codes, sorted; None where they are more than `block`."""
    few = _wanted(kmers, k).select("code").limit(block + 1).toArrow().column("code").to_numpy()  # whether they are few, and then all of them
    return np.sort(few) if len(few) <= block else None


def summed(partial: DataFrame, kmers: DataFrame, k: int, by: tuple[str, ...]) -> DataFrame:
    """by..., ckmer, cnt: partial counts (by..., code, n) added up for the wanted k-mers."""
    return partial.groupBy(*by, "code").agg(F.sum("n").alias("cnt")).join(_wanted(kmers, k), "code").select(*by, "ckmer", "cnt")


def excess(kmers: DataFrame, genome: DataFrame, source: DataFrame, key: str = "probe_id", own: tuple[str, ...] = ()) -> DataFrame:
    """key, total_kmers, off_target, self_only, safe: k-mers of a probe that occur beyond its own source.

    genome: ckmer, cnt over all groups. source: own..., ckmer, cnt in the probe's own sequences.
    """
    total = genome.groupBy("ckmer").agg(F.sum("cnt").alias("_genome"))
    mine = source.groupBy(*own, "ckmer").agg(F.sum("cnt").alias("_source"))
    joined = kmers.join(total, "ckmer", "left").join(mine, [*own, "ckmer"], "left")
    g, s = F.coalesce("_genome", F.lit(0)), F.coalesce("_source", F.lit(0))
    out = joined.groupBy(key).agg(F.count("*").alias("total_kmers"), F.count_if(g > s).alias("off_target"), F.count_if((g > 0) & (g <= s)).alias("self_only"))
    return out.withColumn("safe", F.col("off_target") == 0)


def safe_probes(probes: DataFrame, kmers: DataFrame, counts: DataFrame, key: str = "probe_id") -> DataFrame:
    """Probes none of whose k-mers occurs in the counted reference at all (no own source)."""
    unsafe = kmers.join(counts.where("cnt > 0").select("ckmer").distinct(), "ckmer", "left_semi").select(key).distinct()
    return probes.join(unsafe, key, "left_anti")


def duplication(kmers: DataFrame) -> DataFrame:
    """Totals, distinct k-mers and the share of duplicates, in percent."""
    out = kmers.groupBy("kmer").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("unique_kmers"))
    share = F.when(F.col("total") == 0, 0.0).otherwise((F.col("total") - F.col("unique_kmers")) / F.col("total") * 100)
    return out.withColumn("duplicate_pct", share)


def own_sequences(contigs: DataFrame, sources: DataFrame, versionless: bool = False) -> DataFrame:
    """The contigs of each source's genome: source_id and the contigs' columns.

    A source X_n of a catalog stands for all contigs X_...; a transcript for itself, with or without version.
    """
    if versionless:
        return contigs.withColumn("_k", I.strip_version(F.col("contig"))).join(sources.select("source_id", I.strip_version(F.col("source_id")).alias("_k")), "_k").drop("_k")
    return contigs.withColumn("_k", I.genome_of(F.col("contig"))).join(sources.select("source_id", I.genome_of(F.col("source_id")).alias("_k")), "_k").drop("_k")


def genome_contigs(contigs: DataFrame, genomes: DataFrame) -> DataFrame:
    """contig, genome: whose each contig is. A contig belongs to a genome of its own name or of a prefix of it that ends before an underscore; of several, to the first by `rank`.

    genomes: genome, rank. Names may hold underscores themselves, so every prefix of a contig is looked up, as an ordinary join.
    """
    named = contigs.select("contig").distinct().select("contig", F.explode(I.prefixes(F.col("contig"))).alias("genome"))
    found = named.join(genomes, "genome").groupBy("contig").agg(F.min(F.struct("rank", "genome")).alias("first"))
    return found.select("contig", F.col("first.genome").alias("genome"))


def kmer_of(code_: Column, k: int) -> Column:
    """The k-mer of a 2-bit code."""
    digits = F.lpad(F.conv(code_.cast("string"), 10, 4), k, "0")
    return F.translate(digits, "0123", "ACGT")
