"""Stages: tables and texts that are written once, in a folder that all executors share, and read from there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir. Where that is unset, a local master gets a temporary folder; a cluster has to name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or "cluster" in master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-strandlake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/strandlake-stages/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """df, computed once: what several branches of a plan use isn't scanned again for each."""
    at = path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """df, written once in buckets of a key, so that joins on the key don't shuffle it."""
    spark = df.sparkSession
    table, at = f"strandlake_{name.replace('-', '_')}_{uuid.uuid4().hex}", path(spark, name)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", at).saveAsTable(table)
    return spark.table(table)


def join_hot(rows: DataFrame, table: DataFrame, key: str, salts: int) -> DataFrame:
    """A written stage `rows` joined with `table` on a key. Keys with more than a thousandth of all rows, at most a thousand of them, are joined apart: their rows are dealt over `salts` tasks."""
    counts = keep(rows.groupBy(key).agg(F.count("*").alias("n")), "key-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(counts.where(F.col("n") > max(total / 1000, 1000)).select(key))
    plain = rows.join(hot, key, "left_anti").join(table, key)
    salt = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    left = rows.join(hot, key, "left_semi").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    right = table.join(hot, key, "left_semi").withColumn("_salt", salt)
    return plain.unionByName(left.join(right, [key, "_salt"]).drop("_salt").select(*plain.columns))


def clear(spark: SparkSession) -> None:
    """Delete all stages of this library in the shared folder, once their results have been read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path(spark, "x").rsplit("/", 1)[0])
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
