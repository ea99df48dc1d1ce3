"""Alignments stored for reading by pages.

Rows are sorted over all files by probe, contig, place and strand; a small index says which rows each file holds and between which probes it lies. A page, or a probe's alignments,
are then read from the one or two files that hold them, however many there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORDER = ("probe_id", "rname", "pos", "flag")


def write(hits: DataFrame, path: str, files: int | None = None) -> None:
    """hits as `files` sorted parts (the session's shuffle partitions, if not given) and their index. One probe's many hits may lie in several."""
    spark = hits.sparkSession
    parts = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = hits.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER).withColumn("part", F.spark_partition_id())
    rows.write.partitionBy("part").parquet(f"{path}/rows")
    stored = spark.read.parquet(f"{path}/rows")
    per = stored.groupBy("part").agg(F.count("*").alias("n"), F.min("probe_id").alias("least"), F.max("probe_id").alias("most"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    per.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/index")


def index(spark: SparkSession, path: str) -> DataFrame:
    """part, n, least, most, first: each part's rows, its probes' range, and its first row's number."""
    return spark.read.parquet(f"{path}/index")


def total(spark: SparkSession, path: str) -> int:
    return index(spark, path).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _parts(spark: SparkSession, path: str, numbers: list[int]) -> DataFrame:
    """The rows of these parts; the folders of others aren't even listed."""
    at = f"{path}/rows"
    if not numbers:
        return spark.read.parquet(at).where(F.lit(False))
    return spark.read.option("basePath", at).parquet(*[f"{at}/part={n}" for n in numbers])


def page(spark: SparkSession, path: str, number: int, size: int) -> DataFrame:
    """Page `number` (from 1) of `size` rows, in order; only the parts that hold it are read. `part` says which."""
    if number < 1 or size < 1:
        raise ValueError("pages and sizes start at 1")
    lo, hi = (number - 1) * size, number * size
    held = index(spark, path).where((F.col("first") < hi) & (F.col("first") + F.col("n") > lo)).orderBy("part").collect()
    first = held[0]["first"] if held else 0
    return _parts(spark, path, [r["part"] for r in held]).orderBy(*ORDER).offset(lo - first if held else 0).limit(size)


def of_probe(spark: SparkSession, path: str, probe: str) -> DataFrame:
    """A probe's alignments, from the parts whose range holds it."""
    held = index(spark, path).where((F.col("least") <= probe) & (F.col("most") >= probe)).collect()
    return _parts(spark, path, [r["part"] for r in held]).where(F.col("probe_id") == probe)
