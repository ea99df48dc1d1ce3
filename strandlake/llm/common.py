"""Shared helpers of the corpus operators: stage tables, batch limits, word hashing."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runtime settings of an operator's Python steps: Arrow batches are bounded in bytes, because one document can be very long.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}

#: Set while a stage is written: the shuffle files of that write are freed at its end.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bytes of text that a numpy step handles at once (its words and arrays take about 40 times as much).
CHUNK_BYTES = 2 << 20


def prepare(spark: SparkSession) -> None:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local master gets a temporary folder; a cluster has to name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or "cluster" in master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-strandlake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/strandlake/{name}-{uuid.uuid4().hex}"


@contextmanager
def _freeing(spark: SparkSession) -> Iterator[None]:
    """Frees a write's shuffle files with the write, and leaves the session as it was."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before) if before is not None else spark.conf.unset(FREE_SHUFFLES)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a stage to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    with _freeing(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage = path
    return out


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """A written stage whose rows lie in buckets of a key, so that joins on the key don't shuffle it again."""
    spark = df.sparkSession
    table, path = f"strandlake_{name}_{uuid.uuid4().hex}", stage_path(spark, name)
    rows = df.repartition(buckets, key)
    with _freeing(spark):
        rows.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out.stage, out.table = path, table
    return out


def join_counted(rows: DataFrame, counted: DataFrame, key: str, salts: int = 32) -> DataFrame:
    """rows joined with a written table of their keys' counts (key, n). Keys with more than a thousandth of all counted rows, at most a thousand keys, are dealt over several tasks."""
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    often = F.col("n") > total / 1000
    hot = counted.where(often).select(key, F.lit(True).alias("_hot"))
    rows = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.monotonically_increasing_id(), F.lit(salts))).otherwise(0)).drop("_hot")
    keys = counted.select(key, F.explode(F.when(often, F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))).alias("_salt"))
    return rows.join(keys, [key, "_salt"]).drop("_salt")


def release(*stages: DataFrame | None) -> None:
    """Delete stages that nothing will read again. (A stage that a returned DataFrame still reads stays until `clear`.)"""
    for df in stages:
        path = getattr(df, "stage", None) if df is not None else None
        if path is None:
            continue
        spark = df.sparkSession
        if getattr(df, "table", None):
            spark.sql(f"DROP TABLE IF EXISTS {df.table}")
        _delete(spark, path)


def clear(spark: SparkSession) -> None:
    """Delete all stages in the shared folder, once their results have been read."""
    _delete(spark, f"{shared_folder(spark)}/strandlake")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


# ---------------------------------------------------------------------------------------------
# Words [^\x20\x09-\x0D]+ of many texts at once, as hashes.

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words(dict):
    """The distinct words that a task has met, by number. A caller that keeps something for each word drops both once the table is full; it only saves work."""

    MOST, BYTES = 1 << 20, 64 << 20

    def __init__(self):
        self.fresh: list[bytes] = []
        self.bytes = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        self.bytes += len(word)
        return number

    def full(self) -> bool:
        return len(self) > self.MOST or self.bytes > self.BYTES

    def index(self, words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """The number of each word, and the words that had none, in the order of their new numbers."""
        self.fresh = []
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words)), self.fresh


def split_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The words of the texts in one list, and where each text's begin (one more entry)."""
    split = [t.split() for t in texts]  # of bytes: at the six ASCII blanks
    return list(chain.from_iterable(split)), np.concatenate(([0], np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))))


#: Words of more bytes are hashed one by one, by BLAKE2b.
LONG = 64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # masks of a block's first k bytes


def word_edges(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a buffer that ends with white space begin and end."""
    space = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(buf) and not space[0]:
        edge = np.concatenate(([0], edge))
    return edge[0::2], edge[1::2]


def word_digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each word of the texts as a row of two numbers, and where each text's words begin (one more entry).

    Words are hashed side by side, eight bytes of each at a time: every block is mixed by products and shifts into two lanes that also mix with each other, so that no arrangement of
    letters cancels out as it does in polynomials. The few long words are hashed by BLAKE2b.
    """
    data = b"\n".join(texts) + b"\n"
    buf = np.frombuffer(data, np.uint8)
    start, end = word_edges(buf)
    size = end - start
    blocks = np.ndarray((len(data),), np.dtype("<u8"), data + bytes(8), strides=(1,))
    length = size.astype(np.uint64)
    a, b = length * _U(0xA0761D6478BD642F), length * _U(0xE7037ED1A0B428DB) + _U(0x8EBC6AF09C88C6E3)
    for k in range(0, min(int(size.max(initial=0)), LONG), 8):
        if k:
            rows = np.flatnonzero(size > k)
            value, x, y = blocks[start[rows] + k] & _BYTES[np.minimum(size[rows] - k, 8)], a[rows], b[rows]
        else:
            value, x, y = blocks[start] & _BYTES[np.minimum(size, 8)], a, b
        x = (x ^ value) * _U(0x9E3779B97F4A7C15)
        x ^= x >> _U(29)
        y = (y + value) * _U(0xC2B2AE3D27D4EB4F)
        y ^= x ^ (y >> _U(31))
        x = (x + y) * _U(0xD6E8FEB86659FD93)
        x ^= x >> _U(32)
        if k:
            a[rows], b[rows] = x, y
        else:
            a, b = x, y
    out = np.stack([mix(a + b), mix(b ^ (a * _U(0xA24BAED4963EE407)))], 1)
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = np.frombuffer(hashlib.blake2b(data[start[i] : end[i]], digest_size=16).digest(), _U)
    begins = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)))
    return out, np.searchsorted(start, begins)


def word_hashes(texts: list[bytes], fold_case: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64 bits of each word of the texts, all in one array, and where each text's words begin (one more entry)."""
    values, at = word_digests([t.lower() for t in texts] if fold_case else texts)  # of bytes: A-Z only
    return np.ascontiguousarray(values[:, 0]), at


def word_names(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As word_hashes, with the other 64 bits of each word's hash besides."""
    values, at = word_digests(texts)
    return np.ascontiguousarray(values[:, 0]), np.ascontiguousarray(values[:, 1]), at


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` words (empty if there are fewer). Every word is mixed in, so that no arrangement of few words cancels out."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, width, np.uint64)
    for i in range(width):
        h = mix(h * _BASE + words[i : i + n])
    return h


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes; one long text stays whole."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def utf8(column) -> list[bytes]:
    """A text column of an Arrow batch as UTF-8; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
