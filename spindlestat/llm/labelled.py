"""A bounded, deterministic sample of labelled rows, for the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def crc_mod(id_col: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, keep: Column | None = None, text_col: str = "text") -> DataFrame:
    """(doc_id, text, label) of the documents of at most `most` labelled ids, those that hash lowest.

    `most` also bounds what is broadcast: the chosen ids. Rows without an id or a label take no part; an id that is
    labelled both ways counts as 1; of an id that several documents share, each document is a row.
    """
    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if keep is not None:
        chosen = chosen.filter(keep)
    chosen = chosen.groupBy("doc_id").agg(F.max(label).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
