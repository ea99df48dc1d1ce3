"""SAM text as typed columns, in its three layouts, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    """line, probe_id, flag, rname, gene_id, pos, cigar, seq, nm, md, species.

    A fourth column that is no number is the gene, and shifts the rest; a species tag is optional; short rows are left out;
    a '*' sequence is the probe's last one before it.
    """
    raw = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), "value").where("value NOT LIKE '@%'")
    return typed(raw)


def typed(raw: DataFrame) -> DataFrame:
    c = F.split("value", "\t")
    rows = raw.select("line", "value", c.alias("c")).where(F.size("c") >= 11)
    shift = F.when(F.rlike(F.col("c")[3], F.lit(r"^\d+$")), 0).otherwise(1)
    at = lambda i: F.get("c", F.lit(i) + shift)
    tag = lambda name: F.nullif(F.regexp_extract("value", rf"\t{name}:([^\t]*)", 1), F.lit(""))
    out = rows.select(
        "line", F.col("c")[0].alias("probe_id"), F.col("c")[1].try_cast("int").alias("flag"), F.col("c")[2].alias("rname"), F.when(shift == 1, F.col("c")[3]).alias("gene_id"),
        at(3).try_cast("int").alias("pos"), at(5).alias("cigar"), at(9).alias("seq"), tag("NM:i").try_cast("int").alias("nm"), tag("MD:Z").alias("md"), tag("SP:Z").alias("species"),
    )
    w = Window.partitionBy("probe_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("seq", F.last(F.when(F.col("seq") != "*", F.col("seq")), ignorenulls=True).over(w))


def write(lines: DataFrame, path: str, header: bool = True, single: bool = False) -> None:
    """Lines as SAM text, a file for each partition; the header line is a part of its own before them. single: one file, for a report's size."""
    lines = lines.select("line")
    if header:
        top = lines.sparkSession.createDataFrame([("@HD\tVN:1.4\tSO:unsorted",)], "line string").coalesce(1)
        lines = top.union(lines)  # partitions in this order
    (lines.coalesce(1) if single else lines).write.text(path)


def merge(parts: list[DataFrame]) -> DataFrame:
    """Lines of several SAM texts without their headers."""
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.where("line NOT LIKE '@%'")
