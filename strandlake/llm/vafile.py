"""Exact top-k inner-product search over vector-approximation files.

Vectors are integers floor(scale * x). Two files are written: the exact vectors, a row each, and the approximation, blocks of one byte (`bits`
bits) a component that name the component's cell on a grid. The grid's ends are each component's least and greatest value over all vectors, so its cells are
equally wide, and the middle of a vector's cells is off by at most a radius that only depends on the query.

1. The scan: every block of queries meets every block of cells (an equi-join on block numbers). A product with the cells' middles gives each score's bounds; a
   vector stays in play if its upper bound reaches the k-th best lower bound seen so far.
2. Over all blocks, only vectors whose upper bound reaches the k-th best lower bound are left.
3. Exact vectors are read in the order of their bounds: those of each query's k best bounds first; then only those whose upper bound reaches the k-th
   exact score. Nobody else can be among the k best, so the result is exact.

Nothing is broadcast but the grid (two numbers for each component of each dimension that occurs), and no pair of single rows is made but for vectors in play.

A vector with a component beyond 2^53 after scaling (wild) has no use for cells: it isn't in the approximation, and its products with all others are computed exactly.

Edge cases: vectors that are null or hold null or non-finite components take no part; vectors only meet queries of their own
dimension; an empty vector scores 0 with empty ones; ties go to the smaller id; rows that repeat an id are candidates
each, but a query has no candidate of its own id, and a query id that repeats is answered once per row; finite components
of any size take part, in integers of any size; scores beyond a long's range stop at its ends, where they tie; an empty table or no query gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucketed, materialise, prepare, release

#: Sums of products up to this are exact in float64; beyond, Python's integers add up.
SAFE = float(1 << 53)
_LONG = (-(1 << 63), (1 << 63) - 1)


def _taken(df: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """vec_id, dims, wild, v of the vectors that take part: their integers as float64, which holds them exactly, or a wild vector's own components."""
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall("x", finite))
    wild = F.exists("x", lambda x: F.abs(x * scale) > SAFE)
    whole = F.transform("x", lambda x: F.floor(x * scale).cast("double"))
    rows = rows.withColumn("wild", wild).withColumn("x", F.when(F.col("wild"), F.col("x")).otherwise(whole))
    return rows.select("vec_id", F.size("x").alias("dims"), "wild", "x").mapInArrow(_bytes, "vec_id long, dims int, wild boolean, v binary")


def _bytes(batches):
    """Arrays of numbers as their bytes."""
    for batch in batches:
        lists = batch.column(3)
        values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
        edge = np.concatenate(([0], np.cumsum(batch.column(1).to_numpy(zero_copy_only=False))))
        v = [values[a:b].tobytes() for a, b in zip(edge, edge[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(v, pa.binary())], names=["vec_id", "dims", "wild", "v"])


def _extent(batches):
    """The least and greatest value of each component that the task meets."""
    ends: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for d, x in _by_dims(batch.column(0), batch.column(1)):
            lo, hi = x.min(0), x.max(0)
            if d in ends:
                lo, hi = np.minimum(lo, ends[d][0]), np.maximum(hi, ends[d][1])
            ends[d] = lo, hi
    rows = [(d, i, lo[i], hi[i]) for d, (lo, hi) in ends.items() for i in range(d)]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["dims", "at", "lo", "hi"])


def _by_dims(dims, vectors):
    """The vectors of each dimension as one matrix."""
    size = dims.to_numpy(zero_copy_only=False)
    for d in np.unique(size):
        own = vectors.take(pa.array(np.flatnonzero(size == d))).to_pylist()
        yield int(d), np.frombuffer(b"".join(own), np.float64).reshape(len(own), d)


def cells(x: np.ndarray, lo: np.ndarray, width: np.ndarray, bits: int) -> np.ndarray:
    """The cell of each component."""
    return np.clip((x - lo) / width, 0, (1 << bits) - 1).astype(np.uint8)


def _held(size: int, columns: int, pack, schema: pa.Schema):
    """Rows by dimension (the last column but one) in blocks of `size`."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            out = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(columns)), strict=True):
                rows = held.setdefault(row[-2], [])
                rows.append(row)
                if len(rows) == size:
                    out.append(pack(held.pop(row[-2])))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if held:
            yield pa.RecordBatch.from_pylist([pack(rows) for rows in held.values()], schema)

    return run


BLOCK = pa.schema([("dims", pa.int32()), ("rows", pa.binary()), ("ids", pa.binary()), ("data", pa.binary())])
SPARK_BLOCK = "dims int, rows binary, ids binary, data binary"


def _pack(form):
    """Rows (row, id, dims, vector) as a block, its vectors in a form of their own."""

    def pack(rows):
        row, ids, dims, v = zip(*rows, strict=True)
        x = np.frombuffer(b"".join(v), np.float64).reshape(len(rows), dims[0])
        return {"dims": dims[0], "rows": np.array(row, np.int64).tobytes(), "ids": np.array(ids, np.int64).tobytes(), "data": form(x).tobytes()}

    return pack


def middles(queries: np.ndarray, grid: np.ndarray, lo: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the queries with the middles of the vectors' cells, and how far off each query's may be."""
    scaled = queries * width
    score = scaled @ grid.T.astype(np.float64) + (queries @ (lo + width / 2))[:, None]
    far = np.abs(queries) @ (np.abs(lo) + 257 * width)
    return score, np.abs(scaled).sum(1) / 2 + far * (len(width) + 2) * 1e-15  # half a cell in each component, and float64's rounding


def _scan(k: int, edges: dict[int, tuple[np.ndarray, np.ndarray]]):
    def run(batches):
        at, best = None, None  # the block of queries at work, and its best middles so far
        for batch in batches:
            for r in batch.to_pylist():
                keys, query_ids = np.frombuffer(r["keys"], np.int64), np.frombuffer(r["query_ids"], np.int64)
                rows, ids = np.frombuffer(r["rows"], np.int64), np.frombuffer(r["ids"], np.int64)
                lo, width = edges[r["dims"]]
                queries = np.frombuffer(r["queries"], np.float64).reshape(len(keys), r["dims"])
                score, radius = middles(queries, np.frombuffer(r["data"], np.uint8).reshape(len(rows), r["dims"]), lo, width)
                order = np.argsort(ids, kind="stable")
                first, last = np.searchsorted(ids, query_ids, "left", order), np.searchsorted(ids, query_ids, "right", order)
                for q in np.flatnonzero(first < last):
                    score[q, order[first[q] : last[q]]] = -np.inf  # its own id
                if at != r["query_block"]:
                    at, best = r["query_block"], np.full((len(keys), k), -np.inf)
                top = np.partition(score, -k, axis=1)[:, -k:] if score.shape[1] > k else score
                best = np.sort(np.concatenate([best, top], 1), axis=1)[:, -k:]
                q, v = np.nonzero((score >= (best[:, 0] - 2 * radius)[:, None]) & (score > -np.inf))
                yield pa.RecordBatch.from_arrays([pa.array(keys[q]), pa.array(rows[v]), pa.array(score[q, v]), pa.array(radius[q])], names=["key", "row", "middle", "radius"])

    return run


def _exact(scale: float):
    """The integer inner product of each pair."""
    factor = Fraction(scale)

    def integers(v: bytes, wild: bool) -> list[int]:
        x = np.frombuffer(v, np.float64).tolist()
        return [math.floor(Fraction(a) * factor) for a in x] if wild else [int(a) for a in x]

    def product(a: bytes, b: bytes, wild: tuple[bool, bool]) -> int:
        total = sum(x * y for x, y in zip(integers(a, wild[0]), integers(b, wild[1]), strict=True))
        return min(max(total, _LONG[0]), _LONG[1])

    def run(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            size = batch.column(4).to_numpy(zero_copy_only=False)
            flags = [batch.column(i).to_numpy(zero_copy_only=False) for i in (7, 8)]
            wild = flags[0] | flags[1]
            slow = list(np.flatnonzero(wild))
            for d in np.unique(size[~wild]):
                own = np.flatnonzero((size == d) & ~wild)
                x, y = (np.frombuffer(b"".join(batch.column(i).take(pa.array(own)).to_pylist()), np.float64).reshape(len(own), d) for i in (5, 6))
                out[own] = (x * y).sum(1) if d else 0
                slow.extend(own[(np.abs(x) * np.abs(y)).sum(1) > SAFE])
            for j in slow:
                out[j] = product(batch.column(5)[j].as_py(), batch.column(6)[j].as_py(), (bool(flags[0][j]), bool(flags[1][j])))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(out)], names=["key", "row", "query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding", size: int = 4096, bits: int = 8) -> tuple[DataFrame, DataFrame]:
    """query_id, rank, vec_id, score: each query's k best vectors (all, if fewer) but those of its own id; and key, row: the exact vectors that each query read."""
    spark = vectors.sparkSession
    prepare(spark)

    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    exact = bucketed(_taken(vectors, key, vector, scale).withColumn("row", F.monotonically_increasing_id()), "vectors", "row", buckets)
    asked = materialise(_taken(queries, key, vector, scale).withColumn("key", F.monotonically_increasing_id()), "queries")
    tame, tame_asked = exact.where("NOT wild"), asked.where("NOT wild")
    ends = tame.select("dims", "v").mapInArrow(_extent, "dims int, at int, lo double, hi double").groupBy("dims", "at").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    edges: dict[int, tuple[np.ndarray, np.ndarray]] = {0: (np.zeros(0), np.ones(0))}
    for r in sorted(ends, key=lambda r: (r["dims"], r["at"])):
        lo, width = edges.setdefault(r["dims"], (np.zeros(r["dims"]), np.ones(r["dims"])))
        lo[r["at"]], width[r["at"]] = r["lo"], (r["hi"] - r["lo"]) / (1 << bits) or 1.0

    approximation = tame.select("row", "vec_id", "dims", "v").mapInArrow(_held(size, 4, _pack(lambda x: cells(x, *edges[x.shape[1]], bits)), BLOCK), SPARK_BLOCK)
    approximation = materialise(approximation.withColumn("block", F.monotonically_increasing_id()), "cells")
    held = tame_asked.select("key", "vec_id", "dims", "v").mapInArrow(_held(size // 4, 4, _pack(lambda x: x), BLOCK), SPARK_BLOCK)
    held = materialise(held.withColumn("query_block", F.monotonically_increasing_id()), "query-blocks")
    held = held.select("query_block", "dims", F.col("rows").alias("keys"), F.col("ids").alias("query_ids"), F.col("data").alias("queries"))
    # a row for each pair of blocks of one dimension: block numbers only, as many as (rows / size) x (queries / size)
    pairs = approximation.select("block", "dims").join(held.select("query_block", "dims"), "dims").select("block", "query_block")
    met = pairs.join(approximation, "block").join(held.drop("dims"), "query_block")
    met = met.repartition("query_block", F.pmod("block", F.lit(64))).sortWithinPartitions("query_block")
    found = met.select("query_block", "keys", "query_ids", "queries", "dims", "rows", "ids", "data").mapInArrow(_scan(k, edges), "key long, row long, middle double, radius double")

    best = Window.partitionBy("key").orderBy(F.desc("middle"), "row")
    play = found.withColumn("r", F.row_number().over(best)).withColumn("kth", F.max(F.when(F.col("r") == k, F.col("middle"))).over(Window.partitionBy("key")))
    play = materialise(play.where("kth IS NULL OR middle >= kth - 2 * radius").select("key", "row", "middle", "radius", "r"), "in-play")
    release(approximation, held)

    def scores(pairs: DataFrame) -> DataFrame:
        joined = pairs.join(exact.select("row", "vec_id", "dims", "v", "wild"), "row").join(asked.select("key", F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("wild").alias("wild_q")), "key")
        return joined.select("key", "row", "query_id", "vec_id", "dims", "v", "q", "wild", "wild_q").mapInArrow(_exact(scale), "key long, row long, query_id long, vec_id long, score long")

    first = materialise(scores(play.where(F.col("r") <= k).select("key", "row")), "first-scores")
    least = first.groupBy("key").agg(F.min("score").alias("least"))
    rest = play.where(F.col("r") > k).join(least, "key").where(F.col("middle") + F.col("radius") >= F.col("least"))
    # wild vectors meet all others of their dimension exactly; there are none in most tables
    ask, have = (df.select(F.col(name), F.col("vec_id").alias(f"{name}_id"), "dims", F.col("wild").alias(f"{name}_wild")) for df, name in ((asked, "key"), (exact, "row")))
    extra = ask.where("key_wild").join(have, "dims").unionByName(ask.where("NOT key_wild").join(have.where("row_wild"), "dims")).where("key_id <> row_id")
    read = materialise(first.union(scores(rest.select("key", "row").union(extra.select("key", "row")))), "scores")
    release(first, play, exact, asked)
    w = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id", "row")
    top = read.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return top, read.select("key", "row")


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding", size: int = 4096, bits: int = 8) -> DataFrame:
    """query_id, rank, vec_id, score of `search`."""
    return search(vectors, queries, k, scale, key, vector, size, bits)[0]


#: DuckDB SQL of the query: exact integer products of all queries with all vectors.
SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(v.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id AND len(q.e) = len(v.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
