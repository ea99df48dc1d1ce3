"""Report sinks and their readers: tab tables, GFF3, sidecar JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str) -> None:
    """Tab-separated with a header, one file for each partition."""
    df.write.option("sep", "\t").option("header", True).csv(path)


def write_gff3(lines: DataFrame, path: str, seq_id: str, length: int) -> None:
    """Version and region lines, then the features by start (a report of one gene, one file)."""
    top = [(0, -1, "##gff-version 3"), (0, 0, f"##sequence-region {seq_id} 1 {length}")]
    head = lines.sparkSession.createDataFrame(top, "o int, start int, line string")
    head.union(lines.select(F.lit(1), F.col("start").cast("int"), "line")).coalesce(1).sortWithinPartitions("o", "start", "line").select("line").write.text(path)


def read_gff3(spark: SparkSession, path: str) -> DataFrame:
    """seq_id, type, start, end, strand, attrs (map) of a GFF3 file."""
    c = F.split("value", "\t")
    rows = spark.read.text(path).where("value NOT LIKE '#%'").where(F.size(c) == 9)
    return rows.select(c[0].alias("seq_id"), c[2].alias("type"), c[3].cast("int").alias("start"), c[4].cast("int").alias("end"), c[6].alias("strand"), F.str_to_map(c[8], F.lit(";"), F.lit("=")).alias("attrs"))


def risks_of(gff: DataFrame) -> DataFrame:
    """probe_id, risk, mismatches, description of probe features."""
    a = F.col("attrs")
    return gff.select(a["ID"].alias("probe_id"), a["risk_level"].alias("risk"), a["mismatches"].try_cast("int").alias("mismatches"), a["description"].alias("description"))


METRICS = ("probe_id", "seq", "tm", "gc", "length", "complexity", "structure", "homopolymer", "order_seq")


def write_metrics(table: DataFrame, path: str) -> None:
    """The metrics report as text, two blanks between columns, its heading first."""
    head = ["=" * 245, "NON-ALIGNED PROBE METRICS", "=" * 245, "", "Probe ID  Sequence  Tm(°C)  GC%  Len  Complexity  SecStruct  Homopoly  OrderReadySeq", "-" * 245]
    rows = table.select(F.monotonically_increasing_id().alias("o"), F.concat_ws("  ", *[F.col(c).cast("string") for c in METRICS]).alias("line"))
    top = table.sparkSession.createDataFrame([(i - len(head), x) for i, x in enumerate(head)], "o long, line string")
    top.union(rows).coalesce(1).sortWithinPartitions("o").select("line").write.text(path)  # a report of one run


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a metrics report: its columns, and name (the probe_<n> in its id); headings and rules are left out."""
    c = F.split("value", r"\s+")
    rows = spark.read.text(path).where("value NOT RLIKE '^(#|=|-|Probe|$)'").where(F.size(c) == len(METRICS))
    kinds = {"tm": "double", "gc": "double", "length": "int", "complexity": "double", "structure": "double"}
    out = rows.select(*[c[i].cast(kinds.get(n, "string")).alias(n) for i, n in enumerate(METRICS)])
    return out.withColumn("name", F.regexp_extract("probe_id", r"probe_\d+", 0))


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
