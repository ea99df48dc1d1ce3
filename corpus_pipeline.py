"""The corpus pipeline: five operators in a row, each stage written as Parquet and read again as the next one's documents.

Every stage works on all rows that its predecessor kept. All but the last return the columns of `documents`.

Edge cases: a null text counts as an empty one, stays null until it is packed, and is packed as the end token alone; empty texts and texts without words
are no copies of each other; of rows that share an id, all stay unless an equal or near-equal text has a smaller id; repeated rows are packed each;
an empty table gives no rows; columns other than those of `documents` are left out at the first stage. Very long texts go through whole: one task holds
one such text at a time, with what its operator needs beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import line_dedup, ngram_join, packing, secret_scan, toxicity
from strandlake.llm.common import stage_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _recount(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out(F.col("doc_id")))
    return toxicity.drop_toxic(docs.select(*COLUMNS), toxicity.fit(docs, labels))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go; the documents stay."""
    return _recount(line_dedup.drop_boilerplate(docs.select(*COLUMNS)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngram_join.keep_one(docs.select(*COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become a mark; the documents stay."""
    return _recount(secret_scan.redact(docs.select(*COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 tokens, a row for each piece of a document."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("ngram_jaccard_join", drop_near_copies),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack),
]

#: SQL cannot express the token ids and the connected components; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = stage_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
