"""The queries of this subpackage over the driver's tables, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, backoff_lm, bpe, imatch, media, minhash, packing, quality, secrets, sql, toxicity, url_filter, whitening, winnowing
from .common import id_and_text, table
from .labelled import crc_mod


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.with_clusters(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))


def op2_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) == 2)


def op3_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.encoded(table(spark, sf_dir, "documents")))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = id_and_text(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", secrets.spans_column(F.col("text"), secrets.fit(docs)).alias("s")).select("doc_id", "s.*")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digest=True)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = id_and_text(table(spark, sf_dir, "documents"))
    model = quality.fit(docs, table(spark, sf_dir, "labels"), keep=crc_mod("doc_id", 5) != 0)
    scored = docs.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), model.column(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op8_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = id_and_text(table(spark, sf_dir, "documents"))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), keep=crc_mod("doc_id", 5) != 0)
    scored = docs.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), model.column(F.col("text")).alias("s")).select("doc_id", "held_out", "s.*")
    return scored.withColumn("toxic", (F.col("p_toxic") >= model.cut).cast("int"))


def op10_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), digest=True)
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_backoff_lm, op3_jpeg_media, op4_secret_scan, op5_bpe, op6_quality_classifier, op7_url_filter, op8_minhash_neardup, op9_toxicity, op10_imatch_fingerprints, op11_token_alignment, op12_decontamination, op13_whitening)}
ORACLE_SQL: dict[str, str] = {"op7_url_filter": sql.URL_FILTER, "op12_decontamination": sql.DECONTAMINATION}
