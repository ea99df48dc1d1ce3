"""Weighted rendezvous sharding with DataFrame functions only.

Each shard draws a uniform number from the record key and its own number; the shard with the
highest weighted draw -w / ln(u) takes the record. A new shard only draws for itself, so when it
is added, records move into it and nowhere else.

Edge cases: a null key is hashed as the empty key; equal keys go to one shard; a null or empty text
has no bytes (size 1); repeated rows each get a slot of their own; an empty table gives no rows.
Columns of the input other than the key and the text are ignored; of a very long text only its size and checksum leave the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, prepare


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (an int from 0) of a key among len(weights) shards; weight 0 takes nothing."""
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be non-negative, with one above zero")
    key = F.coalesce(key.cast("string"), F.lit(""))
    draws = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            digits = F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13)
            u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
            draws.append(F.struct((-F.lit(float(weight)) / F.log(u)).alias("draw"), F.lit(-shard).alias("minus")))
    best = draws[0] if len(draws) == 1 else F.greatest(*draws)
    return (-best["minus"]).cast("int")


def shard_documents(docs: DataFrame, weights: Sequence[float], grown: Sequence[float], key: str = "doc_id", text: str = "text", blocks: int = 256, salts: int = 16) -> DataFrame:
    """Rows of docs in shards: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Slots are gapless from 0 in each shard without sorting a shard in one task: rows are numbered in
    `blocks` x `salts` blocks of a shard, and the blocks' counts (a bounded table) give each block's first slot.
    `grown` must extend `weights`.
    """
    if list(grown[: len(weights)]) != list(weights):
        raise ValueError("grown must extend weights")
    prepare(docs.sparkSession)
    body = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit("").cast("binary"))
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    rows = rows.withColumns({"shard": rendezvous(F.col("doc_id"), weights), "grown_shard": rendezvous(F.col("doc_id"), grown)})
    # the salt spreads repeated rows; it is fixed once the stage is written
    rows = rows.withColumn("block", (F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)) * salts + F.pmod(F.monotonically_increasing_id(), F.lit(salts))).cast("int"))
    rows = materialise(rows, "shards")
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("shard", "block").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.withColumn("place", F.row_number().over(own) - 1)
    return numbered.join(F.broadcast(first), ["shard", "block"]).select(  # at most shards x blocks x salts rows
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("place")).alias("slot"), "grown_shard"
    )
