"""Screening of probes that arrive as files in a folder, against a static table of k-mer counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seq as S
from ..operators import kmers, tiling


def read_probes(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of probe_id, seq from FASTA files dropped into a folder."""
    raw = spark.readStream.option("lineSep", "\n>").text(folder)
    body = F.regexp_replace("value", "^>", "")
    return raw.select(F.regexp_extract(body, r"^(\S*)", 1).alias("probe_id"), F.upper(F.regexp_replace(F.substr(body, F.instr(body, "\n") + 1), r"\s", "")).alias("seq")).where("seq <> ''")


def screen(probes: DataFrame, counts: DataFrame, k: int, gc=tiling.GC, tm=tiling.TM) -> DataFrame:
    """Each probe that passes the filters, with how many of its k-mers occur in the reference.

    The k-mers of a probe stay in its row and are looked up in the static side by an ordinary stream-static join;
    counting per probe and batch needs no state beyond the batch (use it in foreachBatch, or in update mode).
    """
    good = probes.where(~F.contains("seq", F.lit("N"))).where(tiling.passes(gc, tm))
    keyed = kmers.explode_kmers(good, k, ("probe_id", "seq"))
    known = counts.groupBy("ckmer").agg(F.sum("cnt").alias("cnt"))
    return keyed.join(known, "ckmer", "left").groupBy("probe_id", "seq").agg(F.count("cnt").alias("hits")).withColumn("gc", S.gc_percent(F.col("seq")))
