"""From raw documents to packed training sequences: five stages, each a function (spark, docs, sf_dir) -> DataFrame.

Every stage works on all rows that the one before kept. All but the last return the columns of documents. A document
without an id or with a null text passes the filters like any other (its text counts as empty); what each operator does
with such rows is said in its module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spindlestat.llm import minhash, packing, quality, secrets, toxicity as toxic
from spindlestat.llm.common import cut_lineage, table

#: A document is rejected below this quality score.
LEAST_QUALITY = 0.3


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the model counts as toxic."""
    model = toxic.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.filter(model.column(F.col("text"))["p_toxic"] < model.cut)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of low quality."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.filter(model.column(F.col("text")) >= LEAST_QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: that of the smallest id."""
    return minhash.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by their kind; n_chars follows."""
    return docs.withColumn("text", secrets.redacted_column(F.col("text"), secrets.fit(docs))).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document, or of its pieces, in sequences of 2048 words."""
    return packing.pack(packing.with_clusters(docs.select("doc_id", "text", "source")))


STAGES = [("toxicity", toxicity), ("quality_classifier", quality_classifier), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("best_fit_packing", best_fit_packing)]

#: Classifiers and sketches have no SQL counterpart; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs
