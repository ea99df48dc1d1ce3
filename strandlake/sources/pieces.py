"""Reference FASTA in pieces: a record of any length is read by all the tasks that Spark splits its file into.

A file's splits lie anywhere in its records. A first pass leaves one row for each split: the last header in it, the bases behind that, and the first bases before any header.
From these, put in the order of the splits, every split learns which record it begins in, how many of the record's bases came before, and the bases
that follow its own end. The second pass cuts pieces: each owns `own` bases from place `at` of its record on, and carries `overlap` more where the record goes on,
so a window that begins in a piece's own bases lies in it whole.

The table of splits passes through the driver: a header and `overlap` bases for each split, whatever the record's length. Compressed files have one split; their
records are cut into pieces all the same. Bases before a file's first header belong to no record and are left out, as are records without bases.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .fasta import CHUNKS

PIECE = 1 << 20
_BLANK = re.compile(r"\s")
SPLITS = "file long, block long, named boolean, header string, lead long, head string, tail long"
PIECES = "file long, header string, at long, own int, seq string"


def _file(path: Column) -> Column:
    """A file by number; local paths are written with one slash or three."""
    return F.xxhash64(F.regexp_replace(path, "^file:/+", "file:/"))


def _lines(spark: SparkSession, path: str | list[str], glob: str) -> DataFrame:
    raw = spark.read.option("pathGlobFilter", glob).text(path)
    return raw.select(_file(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], list[tuple[str | None, str]]]]:
    """For each split in a batch of lines: (header, bases) in order; None: the bases go on with the record before."""
    rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
    for key, lines in groupby(rows, key=lambda r: r[:2]):
        found: list[tuple[str | None, str]] = []
        for is_header, run in groupby((r[2] for r in lines), key=lambda line: line.startswith(">")):
            if is_header:
                found.extend((line[1:].strip(), "") for line in run)
                continue
            bases = _BLANK.sub("", "".join(run)).upper()
            found.append((found.pop()[0] if found else None, bases))
        yield key, found


def _summaries(overlap: int):
    def run(batches):
        rows: dict[tuple[int, int], list] = {}
        for batch in batches:
            for key, found in _parts(batch):
                named, header, lead, head, tail = rows.get(key, (False, None, 0, "", 0))
                for name, bases in found:
                    if name is not None:
                        named, header, tail = True, name, 0
                    if not named:
                        lead += len(bases)
                        head = head if len(head) >= overlap else (head + bases)[:overlap]
                    tail += len(bases)
                rows[key] = [named, header, lead, head, tail]
        columns = list(zip(*((*k, *v) for k, v in rows.items()), strict=True)) if rows else [[]] * 7
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SPLITS.split(", ")])

    return run


def splits(spark: SparkSession, path: str | list[str], overlap: int, glob: str = "*.{fa,fna,fasta,fa.gz,fna.gz}") -> DataFrame:
    """file, block, header, at, after: for each split, the record it begins in (null: none), the record's bases before it, and up to `overlap` bases behind it."""
    found = _lines(spark, path, glob).mapInArrow(_summaries(overlap), SPLITS)
    own = Window.partitionBy("file").orderBy("block")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("record", F.sum(F.col("named").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    found = found.withColumn("so_far", F.sum("tail").over(Window.partitionBy("file", "record").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)))
    # each split but an empty one has a base or a header, so `overlap` bases lie in as many of the next splits at most
    follow = F.collect_list(F.struct("head", "named")).over(own.rowsBetween(1, max(overlap, 1)))
    start = F.struct(F.lit("").alias("bases"), F.lit(False).alias("over"))
    after = F.aggregate(follow, start, lambda a, x: F.struct(F.when(a["over"], a["bases"]).otherwise(F.concat(a["bases"], x["head"])).alias("bases"), (a["over"] | x["named"]).alias("over")), lambda a: a["bases"])
    return found.select("file", "block", F.last("header", ignorenulls=True).over(before).alias("header"), F.coalesce(F.lag("so_far").over(own), F.lit(0)).alias("at"), F.substring(after, 1, overlap).alias("after"))


class _Record:
    """A record's bases as they come, cut into pieces."""

    def __init__(self, file: int, header: str | None, at: int, piece: int, overlap: int):
        self.file, self.header, self.at, self.piece, self.overlap = file, header, at, piece, overlap
        self.parts: list[str] = []
        self.size = 0

    def add(self, bases: str) -> Iterator[tuple]:
        self.parts.append(bases)
        self.size += len(bases)
        if self.size >= self.piece + self.overlap:
            text, i = "".join(self.parts), 0
            while len(text) - i >= self.piece + self.overlap:
                yield from self._row(text[i : i + self.piece + self.overlap], self.piece)
                i += self.piece
            self.parts, self.size = [text[i:]], len(text) - i

    def end(self, after: str = "") -> Iterator[tuple]:
        if self.size:
            yield from self._row("".join(self.parts) + after, self.size)

    def _row(self, text: str, own: int) -> Iterator[tuple]:
        if self.header is not None:
            yield self.file, self.header, self.at, own, text
        self.at += own


def _cut(known, piece: int, overlap: int):
    def run(batches):
        at = record = None  # the split at work, and its record

        def out(rows):
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

        for batch in batches:
            rows: list[tuple] = []
            for key, found in _parts(batch):
                if key != at:
                    if at is not None:
                        rows.extend(record.end(known.value[at][2]))
                    at = key
                    record = _Record(key[0], *known.value[key][:2], piece, overlap)
                for name, bases in found:
                    if name is not None:
                        rows.extend(record.end())
                        record = _Record(key[0], name, 0, piece, overlap)
                    rows.extend(record.add(bases))
            yield out(rows)
        if at is not None:
            yield out(list(record.end(known.value[at][2])))

    return run


def read(spark: SparkSession, path: str | list[str], overlap: int, piece: int = PIECE, glob: str = "*.{fa,fna,fasta,fa.gz,fna.gz}") -> DataFrame:
    """contig, header, file, at, own, seq: the records of FASTA files in pieces, upper case.

    `overlap`: at least the longest window of a later scan, and its gaps. A job runs when this is called (the splits); the split sizes of the session must stay until the pieces are read.
    """
    if piece < 1 or overlap < 0:
        raise ValueError("pieces need a base at least")
    known = {(r["file"], r["block"]): (r["header"], r["at"], r["after"]) for r in splits(spark, path, overlap, glob).collect()}
    lines = _lines(spark, path, glob)
    cut = lines.mapInArrow(_cut(spark.sparkContext.broadcast(known), piece, overlap), PIECES)
    names = spark.createDataFrame([(f,) for f in lines.inputFiles()], "path string").select(_file(F.col("path")).alias("file"), "path")
    named = cut.join(F.broadcast(names), "file", "left")  # a row for each file
    return named.select(F.regexp_extract("header", r"^(\S*)", 1).alias("contig"), "header", F.col("path").alias("file"), "at", "own", "seq")


def contigs(spark: SparkSession, groups: dict[str, str | list[str]], overlap: int, piece: int = PIECE, glob: str = "*.{fa,fna,fasta,fa.gz,fna.gz}", kind: str | None = None) -> DataFrame:
    """contig, genome, grp, file, at, own, seq of the reference files of each group, for the scans of `operators`; kind ('host' or 'microbiome') takes only files named like its chunks."""
    glob = CHUNKS[kind] if kind else glob
    out = None
    for name, path in groups.items():
        part = read(spark, path, overlap, piece, glob).select("contig", F.substring_index("contig", "_", 1).alias("genome"), F.lit(name).alias("grp"), "file", "at", "own", "seq")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no groups")
    return out
