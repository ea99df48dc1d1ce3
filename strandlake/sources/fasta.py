"""FASTA: validation, records and reference contigs, writers.

Files are read by Spark with '\\n>' as the record separator, so a record is a row and files split between records;
compressed files are handled by Spark's codecs.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BASES = re.compile(r"[ATCGNatcgn]+")


def parse(text: str) -> list[tuple[str, str]]:
    """Records (header, sequence) of pasted FASTA; raises ValueError that names the first fault and its line."""
    records: list[list[str]] = []
    for n, raw in enumerate(text.splitlines(), 1):
        line = raw.strip()
        if not line:
            continue
        if line.startswith(">"):
            if records and not records[-1][1]:
                raise ValueError(f"no sequence for header {records[-1][0]!r} before line {n}")
            if not line[1:].strip():
                raise ValueError(f"empty header in line {n}")
            records.append([line[1:].strip(), ""])
        elif not records:
            raise ValueError(f"line {n} stands before any header")
        elif not BASES.fullmatch(line):
            raise ValueError(f"line {n} holds letters other than A, C, G, T, N")
        else:
            records[-1][1] += line.upper()
    if not records:
        raise ValueError("no sequences found")
    if not records[-1][1]:
        raise ValueError(f"no sequence for header {records[-1][0]!r}")
    return [(h, s) for h, s in records]


def one_gene(text: str, length: int) -> tuple[str, str]:
    """The single record of gene input, at least one window long."""
    records = parse(text)
    if len(records) != 1:
        raise ValueError(f"expected one sequence, found {len(records)}")
    if len(records[0][1]) < length:
        raise ValueError(f"the sequence has {len(records[0][1])} bases, fewer than a probe's {length}")
    return records[0]


def read(spark: SparkSession, path: str | list[str], glob: str = "*.{fa,fna,fasta,fa.gz,fna.gz}") -> DataFrame:
    """seq_id, header, seq, file for each record with a sequence; upper case. `path`: files or folders."""
    raw = spark.read.option("pathGlobFilter", glob).text(path, lineSep="\n>").select("value", F.col("_metadata.file_path").alias("file"))
    body = F.regexp_replace("value", "^>", "")
    header = F.trim(F.regexp_replace(F.substring_index(body, "\n", 1), "\r", ""))
    seq = F.upper(F.regexp_replace(F.when(F.contains(body, F.lit("\n")), F.substr(body, F.instr(body, "\n") + 1)).otherwise(""), r"\s", ""))
    return raw.select(F.regexp_extract(header, r"^(\S*)", 1).alias("seq_id"), header.alias("header"), seq.alias("seq"), "file").where("seq <> ''")


def faults(records: DataFrame) -> DataFrame:
    """seq_id, fault: records with an empty header or other letters."""
    fault = F.when(F.col("header") == "", "empty header").when(F.rlike("seq", F.lit("[^ACGTN]")), "letters other than A, C, G, T, N")
    return records.select("seq_id", fault.alias("fault")).where("fault IS NOT NULL")


#: The names of reference chunks, of hosts and of catalogs.
CHUNKS = {"host": "*.{fa,fa.gz}", "microbiome": "*.{fna,fna.gz}"}


def contigs(spark: SparkSession, groups: dict[str, str | list[str]], glob: str = "*.{fa,fna,fasta,fa.gz,fna.gz}", kind: str | None = None) -> DataFrame:
    """contig, genome, grp, seq, file of the reference files of each group; kind ('host' or 'microbiome') takes only files that are named like its chunks."""
    glob = CHUNKS[kind] if kind else glob
    out = None
    for name, path in groups.items():
        part = read(spark, path, glob).select(F.col("seq_id").alias("contig"), F.substring_index("seq_id", "_", 1).alias("genome"), F.lit(name).alias("grp"), "seq", "file")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no groups")
    return out


def wrapped(seq, width: int = 80):
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def write(records: DataFrame, path: str, name: str = "probe_id", seq: str = "seq", order: list[str] | None = None, width: int | None = None) -> None:
    """Records as FASTA text; with `order`, sorted over the files."""
    rows = records.orderBy(*order) if order else records
    body = wrapped(F.col(seq), width) if width else F.col(seq)
    rows.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), body)).write.text(path)


def index_line(name: str, length: int, width: int = 80) -> str:
    """A .fai line of a one-record FASTA."""
    return f"{name}\t{length}\t{len(name.encode()) + 2}\t{width}\t{width + 1}"


FAI = "name string, length long, offset long, width int, line int, file string"


def write_indexed(records: DataFrame, path: str, name: str = "probe_id", seq: str = "seq", width: int = 80, files: int | None = None) -> DataFrame:
    """Records as wrapped FASTA, sorted by name over the files, and the index of where each record's bases begin in its file: name, length, offset, width, line, file.

    The index is written beside the texts, as a table and, for each file, as its .fai lines.
    """
    spark = records.sparkSession
    parts = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = records.select(F.col(name).alias("name"), F.col(seq).alias("seq")).repartitionByRange(parts, "name", "seq").sortWithinPartitions("name", "seq").withColumn("part", F.spark_partition_id())
    rows.write.parquet(f"{path}/records")  # parts and their order stay as they are from here on
    stored = spark.read.parquet(f"{path}/records")
    length = F.length("seq").cast("long")
    head = F.octet_length(F.encode("name", "UTF-8")) + 2
    size = head + length + F.ceil(length / width)  # bytes: a record without bases is its header
    before = Window.partitionBy("part").orderBy("name", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = stored.select("part", "name", "seq", length.alias("length"), (F.coalesce(F.sum(size).over(before), F.lit(0)) + head).cast("long").alias("offset"))
    text = F.concat(F.lit(">"), "name", F.when(length > 0, F.concat(F.lit("\n"), wrapped(F.col("seq"), width))).otherwise(""))
    in_order = placed.withColumns({"value": text, "part": F.format_string("%06d", "part")}).repartition(parts, "part").sortWithinPartitions("part", "name", "seq")
    in_order.select("value", "part").write.partitionBy("part").text(f"{path}/fasta")
    files_ = spark.createDataFrame([(int(re.search(r"/part=(\d+)/", f)[1]), f) for f in spark.read.text(f"{path}/fasta").inputFiles()], "part int, file string")
    index = placed.join(F.broadcast(files_), "part").select("name", "length", "offset", F.lit(width).alias("width"), F.lit(width + 1).alias("line"), "file")
    index.write.parquet(f"{path}/index")
    lines = index.select(F.concat_ws("\t", "name", *[F.col(c).cast("string") for c in ("length", "offset", "width", "line")]).alias("value"), F.regexp_extract("file", r"/part=(\d+)/", 1).alias("part"))
    lines.repartition(parts, "part").write.partitionBy("part").text(f"{path}/fai")
    return spark.read.schema(FAI).parquet(f"{path}/index")


def _ranges(batches):
    """The bases of each region, read from its file by a range of bytes."""
    from pyarrow import fs

    for batch in batches:
        rows = batch.to_pylist()
        out: list[str | None] = [None] * len(rows)
        for file in {r["file"] for r in rows}:
            system, at = fs.FileSystem.from_uri(file)
            with system.open_input_file(at) as f:
                for i, r in enumerate(rows):
                    a, b = max(r["lo"] - 1, 0), min(r["hi"], r["length"])
                    if r["file"] != file:
                        continue
                    if a >= b:
                        out[i] = ""
                        continue
                    first, last = (r["offset"] + x // r["width"] * r["line"] + x % r["width"] for x in (a, b - 1))
                    out[i] = f.read_at(last - first + 1, first).replace(b"\n", b"").decode()
        yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("lo"), batch.column("hi"), pa.array(out, pa.string())], names=["name", "lo", "hi", "seq"])


def fetch(index: DataFrame, regions: DataFrame) -> DataFrame:
    """name, lo, hi, seq: bases lo..hi (from 1, both included; cut at the record's ends) of records of an indexed FASTA. Each region reads its own bytes."""
    asked = regions.select("name", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))
    return asked.join(index, "name").repartition("file").mapInArrow(_ranges, "name string, lo long, hi long, seq string")
