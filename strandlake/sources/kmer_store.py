"""The k-mer database: canonical counts of each group, built once and added to.

Counts lie in runs, one for each build that had something to count: Parquet files sorted by code, with a Bloom filter on the code, in folders by k, run and group. The manifest names the
inputs (a group's files) that each run counted. A build counts only inputs that the manifest lacks for its k; it enters a run only once its files are written, so a build that was lost
half-way leaves files that nobody reads. A group's count of a k-mer is the sum over the runs that the manifest names.

A build is as large as its input's k-mers, so they travel packed: a task sorts and counts some millions at a time and sends, for each group and slice of the codes, the differences of
neighbouring codes and the counts, a byte or two each. The slices of a group meet in one task, which merges them one after the other.

A look-up of few k-mers goes to the row groups whose range and Bloom filter may hold them; of many, it is a join, which shuffles the database only where they are more than a broadcast holds.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kmers, scan

#: Look-ups of up to so many k-mers are filters on the files; of up to so many, joins with a broadcast.
FEW, BROADCAST = 1000, 1 << 20
#: Bases that a task counts at once, packed bytes that it merges at once, and rows that it gives out at once. A worker takes some 60 bytes for each of the first.
HELD, MERGED, GIVEN = 1 << 21, 1 << 20, 1 << 17
#: Leading bits of a code that name its slice.
SLICE_BITS = 12
#: Groups whose files a task writes side by side; with more, its rows are sorted by group first.
WRITERS = 8
ROW_GROUP = 1 << 20
STEP = 1 << 18  # windows made at once
MANIFEST = "k int, grp string, input string, run string"
PACKED = "grp string, slice int, codes binary, counts binary"
COUNTS = "grp string, code long, cnt long"


def pack(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as seven bits a byte, the lowest first and all bytes but a number's last marked; and where each number begins (one more entry)."""
    x = x.astype(np.uint64)
    size = np.ones(len(x), np.int64)
    for b in range(7, 64, 7):
        more = x >> np.uint64(b) > 0
        if not more.any():
            break
        size += more
    at = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(at[-1], np.uint8)
    for b in range(int(size.max(initial=0))):
        r = np.flatnonzero(size > b) if b else slice(None)
        out[at[:-1][r] + b] = (x[r] >> np.uint64(7 * b)).astype(np.uint8) & 127 | ((size[r] > b + 1).astype(np.uint8) << 7)
    return out, at


def unpack(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of packed bytes, and where each begins."""
    end = np.flatnonzero(data < 128)
    begin = np.concatenate(([0], end[:-1] + 1)) if len(end) else end
    size = end - begin + 1
    x = (data[begin] & 127).astype(np.uint64)
    for b in range(1, int(size.max(initial=0))):
        r = np.flatnonzero(size > b)
        x[r] |= (data[begin[r] + b] & 127).astype(np.uint64) << np.uint64(7 * b)
    return x, begin


def _shift(k: int) -> int:
    return max(2 * k - SLICE_BITS, 0)


def _blobs(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """The bytes between neighbouring places, as an Arrow column."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def packed(grp: str | None, code: np.ndarray, n: np.ndarray, k: int) -> pa.RecordBatch:
    """PACKED of a group's sorted distinct codes and their counts: of each slice, the first code's rest and the differences; and the counts less one."""
    part = code >> _shift(k)
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(code) else np.zeros(0, np.int64)
    step = np.diff(code, prepend=0)
    step[first] = code[first] - (part[first] << _shift(k))
    columns = []
    for x in (step, n - 1):
        data, at = pack(x)
        columns.append(_blobs(data, at[np.append(first, len(code))]))
    return pa.RecordBatch.from_arrays([pa.array([grp] * len(first), pa.string()), pa.array(part[first], pa.int32()), *columns], names=[c.split()[0] for c in PACKED.split(", ")])


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of packed bytes, and how many each row has."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    x, begin = unpack(np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]])
    return x, np.diff(np.searchsorted(begin, at - at[0]))


def unpacked(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of PACKED: all codes, their counts, and how many each row has."""
    step, size = _numbers(batch.column(2))
    n, _ = _numbers(batch.column(3))
    step, first = step.astype(np.int64), np.cumsum(size) - size
    total = np.cumsum(step)
    base = (batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64) << _shift(k)) - (total[first] - step[first])
    return total + np.repeat(base, size), n.astype(np.int64) + 1, size


def _summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the sums of their counts."""
    if not len(code):
        return code, n
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    return code[first], np.add.reduceat(n, first)


def _counted(k: int):
    """PACKED of grp, seq: some millions of bases at a time, whatever batches or sequences they come from."""

    def run(batches):
        held: dict[str | None, list[np.ndarray]] = {}
        size = 0

        def parts():
            while held:
                grp, codes = held.popitem()
                codes = np.concatenate(codes)  # behind each sequence a letter that ends all windows
                w = np.concatenate([kmers.canonical_codes(codes[i : i + STEP + k - 1], k) for i in range(0, len(codes), STEP)])
                w.sort()
                first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1]))) if len(w) else np.zeros(0, np.int64)
                yield packed(grp, w[first], np.diff(np.append(first, len(w))), k)

        edge = np.full(1, 4, np.uint8)
        for batch in batches:
            for grp, seq in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for _, codes in scan.pieces(scan.encode((seq.as_py() or "").encode()), k - 1):
                    held.setdefault(grp, []).extend((codes, edge))
                    size += len(codes) + 1
                    if size >= HELD:
                        yield from parts()
                        size = 0
        yield from parts()

    return run


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of one group, of so many packed bytes at a time; a larger row by itself."""
    grp, size = batch.column(0).to_pylist(), np.diff(np.frombuffer(batch.column(2).buffers()[1], np.int32)[batch.column(2).offset : batch.column(2).offset + batch.num_rows + 1])
    begin = held = 0
    for i, n in enumerate(size.tolist()):
        if i > begin and (held + n > MERGED or grp[i] != grp[begin]):
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def _merged(k: int):
    """COUNTS of PACKED in the order of group and slice, in the order of group and code. The last slice of what is merged waits for more of it."""

    def rows(grp, code, n):
        for i in range(0, len(code), GIVEN):
            c = code[i : i + GIVEN]
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(grp, pa.string()), len(c)), pa.array(c), pa.array(n[i : i + GIVEN])], names=[c.split()[0] for c in COUNTS.split(", ")])

    def run(batches):
        last, code, n = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for part in _chunks(batch):
                grp = part.column(0)[0].as_py()
                if grp != last:
                    yield from rows(last, code, n)
                    last, code, n = grp, code[:0], n[:0]
                more, counts, _ = unpacked(part, k)
                code, n = _summed(np.concatenate((code, more)), np.concatenate((n, counts)))
                done = int(np.searchsorted(code, part.column(1)[-1].as_py() << _shift(k)))
                yield from rows(grp, code[:done], n[:done])
                code, n = code[done:], n[done:]
        yield from rows(last, code, n)

    return run


@contextmanager
def _setting(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings of one write; the session is left as it was."""
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """k, grp, input, run: what has been counted."""
    at = f"{path}/manifest"
    return spark.read.schema(MANIFEST).parquet(at) if _exists(spark, at) else spark.createDataFrame([], MANIFEST)


def build(contigs: DataFrame, ks: Sequence[int], path: str) -> dict[int, int]:
    """Count what the database lacks; how many inputs were counted for each k. contigs: grp, seq (whole or in pieces), and `file`, where groups may grow; else a group is one input."""
    spark = contigs.sparkSession
    every = contigs if "file" in contigs.columns else contigs.withColumn("file", F.col("grp"))
    every = every.withColumn("file", F.coalesce("file", F.lit("")))
    inputs = every.select("grp", F.col("file").alias("input")).distinct()
    found = {}
    for k in ks:
        known = manifest(spark, path).where(F.col("k") == k).select("grp", "input")
        fresh = inputs.join(known, ["grp", "input"], "left_anti").collect()  # names of files, as the file system lists them
        found[k] = len(fresh)
        if not fresh:
            continue
        wanted = spark.createDataFrame(fresh, "grp string, file string")
        rows = kmers.own_bases(every.join(F.broadcast(wanted), ["grp", "file"], "left_semi"), k).select("grp", "seq")
        sent = rows.mapInArrow(_counted(k), PACKED).repartition("grp", "slice").sortWithinPartitions("grp", "slice")
        run = uuid.uuid4().hex
        counts = sent.mapInArrow(_merged(k), COUNTS).withColumns({"k": F.lit(k), "run": F.lit(run)})
        few = len({r["grp"] for r in fresh}) <= WRITERS
        out = (counts if few else counts.sortWithinPartitions("grp", "code")).write.mode("append")
        out = out.option("parquet.bloom.filter.enabled#code", "true").option("parquet.block.size", str(8 << 20)).option("parquet.block.row.count.limit", str(ROW_GROUP))
        out = out.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary#code", "false")  # neighbouring codes as differences
        with _setting(spark, {"spark.sql.maxConcurrentOutputFileWriters": str(WRITERS if few else 0), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
            out.partitionBy("k", "run", "grp").parquet(f"{path}/counts")
        spark.createDataFrame([(k, r["grp"], r["input"], run) for r in fresh], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return found


def counts(spark: SparkSession, path: str, k: int, groups: Sequence[str] | None = None) -> DataFrame:
    """grp, code, cnt of every run of the manifest; k, runs and groups prune the folders. A k-mer has a row for each run."""
    known = manifest(spark, path).where(F.col("k") == k)
    runs = [r["run"] for r in (known.where(F.col("grp").isin(*groups)) if groups else known).select("run").distinct().collect()]  # one for each build
    if not runs:
        return spark.createDataFrame([], "grp string, code long, cnt long")
    out = spark.read.schema("code long, cnt long, k int, run string, grp string").parquet(f"{path}/counts").where((F.col("k") == k) & F.col("run").isin(*runs))
    return (out.where(F.col("grp").isin(*groups)) if groups else out).select("grp", "code", "cnt")


def lookup(spark: SparkSession, path: str, wanted: DataFrame, k: int, groups: Sequence[str] | None = None) -> DataFrame:
    """grp, ckmer, cnt of the wanted canonical k-mers (column ckmer) that occur."""
    codes = wanted.select("ckmer").distinct().select(kmers.code(F.col("ckmer"), k).alias("code"))
    few = [r["code"] for r in codes.limit(FEW + 1).collect()]
    found = counts(spark, path, k, groups)
    if 0 < len(few) <= FEW:
        found = found.where(F.col("code").isin(*few))
    else:
        found = found.join(F.broadcast(codes) if codes.count() <= BROADCAST else codes, "code", "left_semi")
    return found.groupBy("grp", "code").agg(F.sum("cnt").alias("cnt")).select("grp", kmers.kmer_of(F.col("code"), k).alias("ckmer"), "cnt")
