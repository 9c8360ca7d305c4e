"""Benchmark decontamination by winnowing, native: passages that documents share with benchmark items, as whole runs of words.

A window is LENGTH consecutive words of an item, or a shorter item as a whole. A window of n words has n - k + 1 grams of k
words (k by n: 4, 2 or 1). Its fingerprint is the least hash of those grams. So wherever a document holds the window, the
same grams stand in the same order, and the least of them is the same: no shared window can be missed. Documents are
walked in windows of each length that items have. Neighbouring windows mostly share their least gram, so a document keeps
one row for each run of windows with one fingerprint, between a third and a quarter as many as words, with the
fingerprint, the place, and the hashes of the windows in the run.

1. Rows whose fingerprint no window of an item has are dropped. Fingerprints of items, and windows, are distinct before
   they are joined, so a passage that stands in many items meets each document once. They are broadcast if they are
   counted to be few; else both sides are shuffled.
2. What is left is extended: each window of a run is looked up by the hash of its whole. Windows that overlap or touch are
   merged into spans.
3. Windows that stand in the same items are one class. A document has a set of classes; items are listed once for each set
   that occurs, and then joined to the documents that have it, however many (a set of many documents is broadcast).

Hashes of words and windows have 64 bits; two different windows count as the same with a probability of 5e-20.

Null and empty texts, and texts without words, have no words and no hits; such items have no windows. Rows that repeat an id
are documents of their own; rows of `items` that repeat one are one item, with the windows of all. Null ids stay null in
documents; an item without an id is listed as the empty string. Empty tables give an empty result, or documents without
hits. Long texts are one row each. Other columns aren't looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut_lineage, few
from .components import with_found

LENGTH = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, once A-Z are lower-cased; and signs outside ASCII that lower() may change.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OTHER_CASES = r"[[\p{javaUpperCase}\p{javaTitleCase}\p{Cn}]&&[^\x00-\x7F]]"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased. lower() is the faster way where it changes nothing else."""
    plain = (F.octet_length(text) == F.length(text)) | ~F.rlike(text, F.lit(OTHER_CASES))
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), BETWEEN), "")


def gram_words(n: int) -> int:
    """Words of a gram of a window of n words."""
    return 4 if n >= 7 else 2 if n >= 3 else 1


def _shifted(a: Column, by: int) -> Column:
    return F.slice(a, by + 1, F.size(a)) if by else a


def _hashed(a: Column, b: Column, by: int) -> Column:
    """The hash of a[i] and b[i + by]; entries towards the end, that lack the second, are of no use."""
    return F.zip_with(a, _shifted(b, by), lambda x, y: F.xxhash64(x, y))


def _least(a: Column, by: int) -> Column:
    return F.zip_with(a, _shifted(a, by), lambda x, y: F.least(x, y))


def with_grams(rows: DataFrame) -> DataFrame:
    """Adds g1, g2, g4, g8: the hashes of so many words from each word of `words` on."""
    rows = rows.withColumn("g1", F.transform("words", lambda w: F.xxhash64(w))).drop("words")
    for k in (1, 2, 4):
        rows = rows.withColumn(f"g{2 * k}", _hashed(F.col(f"g{k}"), F.col(f"g{k}"), k))
    return rows


def with_windows(rows: DataFrame, n: int) -> DataFrame:
    """Adds p{n} and w{n}: fingerprint and hash of the window of n words from each word on, as many as there are."""
    left, at, whole = n, 0, None
    for k in (8, 4, 2, 1):  # a window is made of grams of falling length
        if left >= k:
            whole = F.col(f"g{k}") if whole is None else _hashed(whole, F.col(f"g{k}"), at)
            left, at = left - k, at + k
    rows = rows.withColumn(f"w{n}", whole)
    k = gram_words(n)
    rows, have, wanted = rows.withColumn(f"p{n}", F.col(f"g{k}")), 1, n - k + 1
    while have < wanted:  # the least of 1, 2, 4 ... grams
        by = min(have, wanted - have)
        rows, have = rows.withColumn(f"p{n}", _least(F.col(f"p{n}"), by)), have + by
    many = F.greatest(F.size("g1") - (n - 1), F.lit(0))
    return rows.withColumns({c: F.slice(c, F.lit(1), many) for c in (f"p{n}", f"w{n}")})


def runs(n: int) -> Column:
    """(fingerprint, start, windows) for each run of neighbouring windows with one fingerprint."""
    p, w = F.col(f"p{n}"), F.col(f"w{n}")
    starts = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: ~F.get(p, i).eqNullSafe(F.get(p, i - 1)))

    def cut(starts: Column) -> Column:
        return F.transform(starts, lambda i, k: F.struct(p[i].alias("fingerprint"), i.alias("start"), F.slice(w, i + 1, F.coalesce(F.get(starts, k + 1), F.size(p)) - i).alias("windows")))

    return F.when(F.size(p) > 0, F.transform(F.array(starts), cut)[0])


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(item, window, fingerprint, n): the distinct windows of each item; materialised."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("words"))
    rows = with_grams(rows.withColumn("n", F.least(F.size("words"), F.lit(length))))
    parts = []
    for n in range(1, length + 1):
        own = with_windows(rows.filter(F.col("n") == n), n)
        parts.append(own.select("item", "n", F.explode(F.arrays_zip(F.col(f"w{n}").alias("window"), F.col(f"p{n}").alias("fingerprint"))).alias("x")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return cut_lineage(out.select("item", "x.window", "x.fingerprint", "n").distinct())


def overlaps(docs: DataFrame, items: DataFrame, length: int = LENGTH, digest: bool = False, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items of every document, and its spans (start and end, in words) with the items (their ids, sorted), or (digest) items_sha256: their ids, comma-joined, as SHA-256."""
    known = item_windows(items, item_id_col, item_text_col, length)
    lengths = sorted(r["n"] for r in known.select("n").distinct().collect())  # `length` of them at most
    sums = [F.count(F.lit(1)), F.bit_xor(F.xxhash64("item")), F.bit_xor(F.xxhash64(F.lit(1), F.col("item")))]
    windows = known.groupBy("window").agg(F.max("n").alias("length"), F.xxhash64(*sums).alias("class"))
    windows = cut_lineage(windows)
    prints = few(cut_lineage(known.select("fingerprint").distinct()))
    # all that is needed of a document: a row about itself, and one for each of its runs that some item may share
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), words(F.col(text_col)).alias("words"))
    rows = with_grams(rows.withColumn("n_words", F.size("words").cast("long")))
    for n in lengths:
        rows = with_windows(rows, n)
    own = F.array(F.struct(F.lit(None).cast("long").alias("fingerprint"), F.lit(-1).alias("start"), F.lit(None).cast("array<bigint>").alias("windows")))
    found = rows.select("doc_id", "row", "n_words", F.explode(F.concat(own, *[F.coalesce(runs(n), F.slice(own, 1, 0)) for n in lengths])).alias("x")).select("doc_id", "row", "n_words", "x.*")
    kept = found.join(prints.withColumn("shared", F.lit(True)), "fingerprint", "left").filter((F.col("start") < 0) | F.col("shared"))
    kept = cut_lineage(kept.select("doc_id", "row", "n_words", "start", "windows"))
    texts = kept.filter("start < 0").select("doc_id", "row", "n_words")
    # windows of the runs, looked up as wholes
    hits = kept.filter("start >= 0").select("row", "start", F.posexplode("windows").alias("k", "window")).join(few(windows), "window")
    hits = hits.select("row", (F.col("start") + F.col("k")).alias("start"), (F.col("start") + F.col("k") + F.col("length")).alias("end"), "class")
    w = Window.partitionBy("row").orderBy("start")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    hits = hits.withColumn("span", F.when(before >= F.col("start"), 0).otherwise(1)).withColumn("span", F.sum("span").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = hits.groupBy("row", "span").agg(F.struct(F.min("start").alias("start"), F.max("end").alias("end")).alias("span_"), F.collect_set("class").alias("classes"))
    per = spans.groupBy("row").agg(F.sum(F.col("span_.end") - F.col("span_.start")).cast("long").alias("n_hit"), F.array_sort(F.collect_list("span_")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("classes")))).alias("classes"))
    per = cut_lineage(per.withColumns({"s1": F.xxhash64("classes"), "s2": F.xxhash64(F.lit(1), F.col("classes"))}))
    # items of each set of classes
    example = windows.groupBy("class").agg(F.min("window").alias("window"))
    of_class = cut_lineage(known.join(few(cut_lineage(example)), "window").select("class", "item").distinct())
    sets = per.groupBy("s1", "s2").agg(F.first("classes").alias("classes"), F.count(F.lit(1)).alias("n"))
    listed = sets.select("s1", "s2", "n", F.explode("classes").alias("class")).join(few(of_class), "class").groupBy("s1", "s2").agg(F.max("n").alias("n"), F.array_sort(F.collect_set("item")).alias("items"))
    listed = listed.withColumn("n_items", F.size("items").cast("long"))
    if digest:
        listed = listed.withColumn("items_sha256", F.sha2(F.concat_ws(",", "items"), 256)).drop("items")
    per = with_found(per.drop("classes"), ["s1", "s2"], listed, per.count(), "n")
    out = texts.join(per.drop("s1", "s2"), "row", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_hit", "n_items")})
    if digest:
        return out.select("doc_id", "n_words", "n_hit", "n_items", F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"))
    none = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c)
    return out.select("doc_id", "n_words", "n_hit", "n_items", none("spans"), none("items"))
