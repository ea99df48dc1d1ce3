"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import differencing, importance, line_dedup, media, ngram_join, packing, secret_scan, sharding, sp_codec, spelling, substring_dedup, toxicity, vafile


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = line_dedup.drop_boilerplate(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.summary(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.score(docs, model)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vafile.exact_top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = media.store_media(_table(spark, sf_dir, "documents"))
    columns = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")
    return media.media_columns(index, folder).select(*columns)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sp_codec.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), rate=0.1, seed=17)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.drop_repeats(_table(spark, sf_dir, "documents"), digest=True)
    return out.withColumnRenamed("kept", "kept_sha256")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), weights=[1.0] * 16, grown=[1.0] * 17)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op13_differencing_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return differencing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_line_dedup": op2_line_dedup,
        "op3_secret_scans": op3_secret_scans,
        "op4_toxicity": op4_toxicity,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_exact_topk": op6_exact_topk,
        "op7_media_columns": op7_media_columns,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_sharding": op10_sharding,
        "op11_importance_resampling": op11_importance_resampling,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_differencing_packing": op13_differencing_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": line_dedup.SQL, "op3_secret_scans": secret_scan.sql(), "op6_exact_topk": vafile.SQL}
