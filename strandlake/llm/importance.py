"""Importance resampling towards a target distribution, with exact selection by weighted medians of medians.

Documents are bags of hashed word n-grams. Two arrays of `buckets` counts, one of all documents and one of the target, give each bucket's gain: a scaled log ratio of its smoothed
shares. A document's weight is the sum of its features' gains (an array look-up), its score the weight plus Gumbel noise keyed by its id, so that the highest scores
are a draw without replacement in proportion to the weights.

The cutoff among all scores is found without sorting them. Each task answers with its size and the median of its keys still in question; the median of these medians,
weighted by the sizes, has at least a quarter of the keys on either side; one of the sides goes, and the answer for both sides comes from the same scan. Only the winners are sorted.

Edge cases: a null or empty text has no features and weight 0; a null id is drawn with the empty id and stands behind all others among equal scores; rows that repeat an id have equal
noise, and take part each; ties in score go to the smaller id, then to the row read first; an empty table gives no rows, an empty target a defined draw; other columns are ignored. A text is read whole, however long: one task holds it, its words and its features at a time.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, chunks, materialise, prepare, release, utf8

_LONGEST = (1 << 63) - 1


def words_table() -> bytes:
    """Bytes to themselves in lower case where a word may hold them (digits, letters, all beyond ASCII), to a blank elsewhere."""
    out = bytearray(b" " * 256)
    for b in range(256):
        if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80:
            out[b] = b
        elif 0x41 <= b <= 0x5A:
            out[b] = b + 32
    return bytes(out)


_TABLE = words_table()


def _shift_tables(longest: int) -> np.ndarray:
    """For n = 0..longest, what CRC-32 makes of each byte of a checksum when n zero bytes follow: checksums of joined texts come from those of their parts."""
    rows = np.zeros((longest + 1, 32), np.uint32)  # the 32 images of single bits
    rows[0] = np.uint32(1) << np.arange(32, dtype=np.uint32)
    step = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)  # the register's table
    for n in range(1, longest + 1):
        x = rows[n - 1]
        rows[n] = step[x & np.uint32(255)] ^ (x >> np.uint32(8))
    out = np.zeros((longest + 1, 4, 256), np.uint32)
    for k in range(4):
        for b in range(8):
            out[:, k, np.arange(256) >> b & 1 == 1] ^= rows[:, 8 * k + b, None]
    return out


LONGEST = 255
_SHIFT = _shift_tables(LONGEST).reshape(-1)


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The checksums' part in that of a text with n (up to LONGEST) more bytes."""
    at = n * 1024
    out = _SHIFT[at + (crc & np.uint32(255))]
    for k in (1, 2, 3):
        out = out ^ _SHIFT[at + 256 * k + (crc >> np.uint32(8 * k) & np.uint32(255))]
    return out


class _Checksums:
    """CRC-32 and length of the words met."""

    def __init__(self):
        self.words = Words()
        self.crc, self.size = np.zeros(1 << 12, np.uint32), np.zeros(1 << 12, np.int64)

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        index, fresh = self.words.index(words)
        n = len(self.words)
        if n > len(self.crc):
            grow = max(n, 2 * len(self.crc)) - len(self.crc)
            self.crc, self.size = np.append(self.crc, np.zeros(grow, np.uint32)), np.append(self.size, np.zeros(grow, np.int64))
        if fresh:
            self.crc[n - len(fresh) : n] = np.fromiter(map(zlib.crc32, fresh), np.uint32, len(fresh))
            self.size[n - len(fresh) : n] = np.fromiter(map(len, fresh), np.int64, len(fresh))
        out = self.crc[index], self.size[index]
        if self.words.full():
            self.words = Words()
        return out


_CHECKSUMS = _Checksums()
_BLANK = np.array([zlib.crc32(b" ")], np.uint32)


def features(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each run of one to three words, the text it is of, and each text's number of words."""
    split = [t.translate(_TABLE).split() for t in texts]
    count = np.fromiter(map(len, split), np.int64, len(split))
    words = [w for s in split for w in s]
    crc, size = _CHECKSUMS.of(words)
    of = np.repeat(np.arange(len(texts)), count)
    found, texts_of = [crc], [of]
    if len(words) > 1:
        spaced = shifted(crc, np.ones(len(crc), np.int64)) ^ _BLANK  # of the word and a blank
        run = spaced[:-1]
        for n in (2, 3):
            if len(words) < n:
                break
            same = of[n - 1 :] == of[: 1 - n]
            last, length = crc[n - 1 :], size[n - 1 :]
            far = length > LONGEST - 1
            out = shifted(run, np.where(far, 0, length)) ^ last
            for i in np.flatnonzero(far & same):
                out[i] = zlib.crc32(b" ".join(words[i : i + n]))
            found.append(out[same])
            texts_of.append(of[n - 1 :][same])
            if n == 2:
                run = (shifted(run, np.where(far, 0, length + 1)) ^ spaced[1:])[: len(words) - 2]
                for i in np.flatnonzero(far[: len(run)]):
                    run[i] = zlib.crc32(b" ".join(words[i : i + 2]) + b" ")
    return (np.concatenate(found) % np.uint32(buckets)).astype(np.int64), np.concatenate(texts_of), count


def _count(buckets: int):
    """One row for each task: its counts of all buckets."""

    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            texts = utf8(batch.column(0))
            for begin, end in chunks(texts):
                counts += np.bincount(features(texts[begin:end], buckets)[0], minlength=buckets)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array([counts.tolist()], pa.list_(pa.int64()))], names=["counts"])

    return run


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """Counts of all buckets over one column of texts: summed in Spark, `buckets` numbers come back."""
    per_task = texts.mapInArrow(_count(buckets), "counts array<long>")
    out = np.zeros(buckets, np.int64)
    for r in per_task.select(F.posexplode("counts").alias("b", "n")).groupBy("b").agg(F.sum("n").alias("n")).collect():
        out[r["b"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """floor(scale * log ratio) of each bucket's smoothed shares."""
    n = len(source)
    s, t = float(source.sum() + n), float(target.sum() + n)
    return np.array([math.floor(scale * math.log((float(b) + 1) * s / ((float(a) + 1) * t))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weigh(gain: np.ndarray):
    def run(batches):
        for batch in batches:
            texts = utf8(batch.column(1))
            for begin, end in chunks(texts):
                bucket, of, words = features(texts[begin:end], len(gain))
                n = end - begin
                order = np.argsort(of, kind="stable")
                total = np.concatenate(([0], np.cumsum(gain[bucket[order]])))
                edge = np.searchsorted(of[order], np.arange(n + 1))
                size = np.diff(edge)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, n), pa.array(size), pa.array(words), pa.array(total[edge[1:]] - total[edge[:-1]])], names=["doc_id", "n_features", "n_words", "weight"])

    return run


Key = tuple[int, int, int]  # -score, id, row: the lesser, the better

ANSWER = "lower long, l0 long, l1 long, l2 long, upper long, u0 long, u1 long, u2 long"


def _answers(low: Key | None, pivot: Key | None, high: Key | None):
    """Of a task's keys in (low, high]: how many are at most the pivot and how many beyond it, and the median of each side."""

    def below(keys: np.ndarray, bound: Key) -> np.ndarray:
        """Which keys are at most the bound."""
        a, b, c = keys
        return (a < bound[0]) | ((a == bound[0]) & ((b < bound[1]) | ((b == bound[1]) & (c <= bound[2]))))

    def run(batches):
        held = []
        for batch in batches:
            keys = np.stack([x.to_numpy(zero_copy_only=False) for x in batch.columns])
            if low is not None:
                keys = keys[:, ~below(keys, low)]
            if high is not None:
                keys = keys[:, below(keys, high)]
            held.append(keys)
        keys = np.concatenate(held, 1) if held else np.zeros((3, 0), np.int64)
        if not keys.shape[1]:
            return
        first = below(keys, pivot) if pivot is not None else np.zeros(keys.shape[1], bool)
        row: list[int | None] = []
        for side in (keys[:, first], keys[:, ~first]):
            n = side.shape[1]
            row.append(n)
            row.extend(side[:, np.lexsort(side[::-1])[(n - 1) // 2]].tolist() if n else (None, None, None))
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], names=[c.split()[0] for c in ANSWER.split(", ")])

    return run


def _weighted_median(medians: list[tuple[Key, int]]) -> Key:
    """The least of the medians that has half of all keys in tasks whose median is at most it."""
    medians.sort()
    half, seen = sum(n for _, n in medians), 0
    for key, n in medians:
        seen += n
        if 2 * seen >= half:
            return key
    raise ValueError("no keys")


def cutoff(keys: DataFrame, take: int) -> tuple[Key | None, list[tuple[int, int]]]:
    """The key of rank `take` among unique keys (three long columns, compared in order), and for each round how many keys were in question and how many it left.

    A round's jobs return one row for each task, whatever the number of keys.
    """
    low = high = pivot = None
    rounds: list[tuple[int, int]] = []
    if take <= 0:
        return None, rounds
    while True:
        found = keys.mapInArrow(_answers(low, pivot, high), ANSWER).collect()
        lower, upper = sum(r["lower"] for r in found), sum(r["upper"] for r in found)
        if pivot is not None:
            side = "lower" if lower >= take else "upper"
            rounds.append((lower + upper, lower if side == "lower" else upper))
            if side == "lower":
                high = pivot
                if lower == 1:  # keys are unique, so the pivot alone is left
                    return pivot, rounds
            else:
                low, take = pivot, take - lower
        else:
            side = "upper"
            if take > upper:
                raise ValueError("fewer keys than are to be taken")
        k = side[0]
        medians = [((r[f"{k}0"], r[f"{k}1"], r[f"{k}2"]), r[side]) for r in found if r[side]]
        if not medians:
            raise ValueError("fewer keys than are to be taken")
        pivot = _weighted_median(medians)


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = 10000, seed: int = 42, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn) for each row of docs."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    gain = gains(bucket_counts(docs.select("text"), buckets), bucket_counts(target.select(F.col(target_text).alias("text")), buckets))
    scored = docs.mapInArrow(_weigh(gain), "doc_id long, n_features long, n_words long, weight long")
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    noise = F.floor(-1000 * F.log(-F.log((F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0))))
    scored = scored.withColumn("score", (F.col("weight") + noise).cast("long")).withColumn("row", F.monotonically_increasing_id())
    scored = materialise(scored, "scored")

    able = scored.where(F.col("n_words") >= least_words)
    n = able.count() * percent // 100
    order = [-F.col("score"), F.coalesce("doc_id", F.lit(_LONGEST)), F.col("row")]
    last, _ = cutoff(able.select(*order), n)
    columns = ("doc_id", "n_features", "weight", "score")
    if last is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    a, b, c = order
    wins = (F.col("n_words") >= least_words) & ((a < last[0]) | ((a == last[0]) & ((b < last[1]) | ((b == last[1]) & (c <= last[2])))))
    # winners are sorted over all tasks: ranges of scores, the rank in each, and the counts of those before it
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = scored.where(wins).withColumns({"k0": a, "k1": b}).repartitionByRange(parts, "k0", "k1", "row").withColumn("part", F.spark_partition_id())
    sorted_ = materialise(sorted_, "winners")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each part
    first = sorted_.groupBy("part").agg(F.count("*").alias("c")).select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("first"))
    ranked = sorted_.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("k0", "k1", "row"))).join(F.broadcast(first), "part")
    return scored.where(~wins).select(*columns, F.lit(None).cast("long").alias("rank")).union(ranked.select(*columns, (F.col("first") + F.col("at")).cast("long").alias("rank")))
