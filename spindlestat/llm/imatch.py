"""Document fingerprints by I-Match, native: terms within a band of document frequencies, sorted and hashed by lexicon subset.

Terms are the distinct lower-cased runs of non-space characters of a text. The lexicon keeps those that stand in a share
of LOW to HIGH of all documents (and in two at least), where a large group of near copies counts about as much as one
document: each of its members as 1 / its size, which is how many documents share a smallest hash of four-word shingles
with it (the second greatest of SKETCHES such numbers, if at least HIGH / 50 of all documents). As a document has so many distinct terms on average, at most that
many / LOW terms can be in the lexicon: its size doesn't grow with the corpus, so it is broadcast (beyond MOST_TERMS, as
with texts of millions of terms, it is joined by shuffle).

A fingerprint has SLOTS slots. Slot 0 is for the whole lexicon, as in plain I-Match; each other slot is for a random
subset of it that keeps a term with probability 1/16 to 1/512. A slot is the hash of the sorted terms of the text that
are in its subset, `-` if there are none. Small subsets outlast edits, large ones tell texts apart. The likeness of two
fingerprints is the share of equal slots among those that either fills. A text without any term of the lexicon has slots
over all its terms, a text without any term its hash. A copy with a term of the lexicon is unlike a copy without any.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import BROADCAST_ROWS, cut_lineage

LOW, HIGH, SLOTS, MOST_TERMS = 0.001, 0.05, 48, 2_000_000
#: Documents of a bucket (of neighbouring ids). Bounds of buckets are found in two steps of STEP each, so there are STEP^2 at
#: most, eight megabytes of broadcast; from there on (300 million documents) buckets grow, to 100 MB at 100 TB.
BUCKET_DOCS, STEP = 256, 1024
#: Sketches of a text; the weight of a text that stands for itself.
SKETCHES, UNIT = 8, 1 << 20
BLANKS = r"[\x20\x09-\x0D]+"


#: What hashes are combined with, for as many orders of them.
ORDERS = [(i + 1) * 0x9E3779B97F4A7C15 % (1 << 64) - (1 << 63) for i in range(SKETCHES)]


def terms(text: Column) -> Column:
    """The distinct terms, and first the empty string, which stands for the text itself."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.lower(text), BLANKS)))


def slot_bits(slot: int) -> int:
    """The bits of a term's hash that must all be 0 for the term to be in the slot's subset: 4 to 9 of them, none for slot 0."""
    if slot == 0:
        return 0
    n, out, x = 4 + (slot - 1) % 6, 0, slot
    while out.bit_count() < n:
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out |= 1 << (x >> 58)
    return out - (1 << 64) if out >> 63 else out


def let(x: Column, f) -> Column:
    """f(x), with x computed once."""
    return F.transform(F.array(x), f)[0]


def sketch(text: Column) -> Column:
    """SKETCHES smallest hashes of the text's shingles of four words, each in another order of the hashes."""
    joined = lambda a, k: F.zip_with(a, F.slice(a, k + 1, F.size(a)), lambda p, q: F.xxhash64(p, q))
    least = lambda a, i: F.array_min(F.transform(a, lambda x: x.bitwiseXOR(F.lit(ORDERS[i]))))
    hashes = F.transform(F.split(F.lower(text), BLANKS), lambda w: F.xxhash64(w))
    return let(let(let(hashes, lambda a: joined(a, 1)), lambda a: joined(a, 2)), lambda a: F.array(*[least(a, i) for i in range(SKETCHES)]))


def weighted(docs: DataFrame, n: int, least: float) -> tuple[DataFrame, int]:
    """(text, w): UNIT over the size of the text's group of near copies, if that is of `least` documents or more; and the sum of w.

    Sketches are made once and written. The weights of texts in large groups are then found by the hash of the text, if
    few texts have one; else they are worked out from the text once more, so that no text ever travels.
    """
    sketched = cut_lineage(docs.select(F.xxhash64("text").alias("h"), sketch(F.col("text")).alias("keys")))
    keys = sketched.select(F.posexplode("keys").alias("i", "key")).groupBy("i", "key").count().filter(F.col("count") >= max(2, least)).collect()
    if not keys:
        return docs.select("text", F.lit(UNIT).cast("long").alias("w")), n * UNIT

    def with_weight(rows: DataFrame) -> DataFrame:
        for i in range(SKETCHES):
            large = docs.sparkSession.createDataFrame([(r["key"], r["count"]) for r in keys if r["i"] == i], f"k{i} long, c{i} long")
            rows = rows.join(F.broadcast(large), F.col("keys")[i] == F.col(f"k{i}"), "left")
        size = F.sort_array(F.array(*[F.coalesce(f"c{i}", F.lit(1)) for i in range(SKETCHES)]), asc=False)[1]
        return rows.withColumn("w", F.floor(UNIT / size)).drop("keys", *[f"{c}{i}" for c in "kc" for i in range(SKETCHES)])

    weights = cut_lineage(with_weight(sketched))
    total = weights.agg(F.sum("w")).first()[0]
    light = cut_lineage(weights.filter(F.col("w") < UNIT).distinct())
    if light.count() > BROADCAST_ROWS:
        return with_weight(docs.select("text", sketch(F.col("text")).alias("keys"))), total
    rows = docs.select("text", F.xxhash64("text").alias("h")).join(F.broadcast(light), "h", "left")
    return rows.select("text", F.coalesce("w", F.lit(UNIT).cast("long")).alias("w")), total


def mask_of(bits: Column) -> Column:
    """The slots that a term is in, as the bits of a number."""
    out = F.lit(0).cast("long")
    for slot in range(SLOTS):
        out = out.bitwiseOR(F.when(bits.bitwiseAND(F.lit(slot_bits(slot))) == 0, F.lit(1 << slot).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(term, mask): the hashes of the terms within the band, and the slots that each is in; a last row for the empty string, with a null mask."""
    n = docs.count()
    rows, n = weighted(docs, n, high / 50 * n)
    counted = rows.select("w", terms(F.col("text")).alias("terms")).select("w", F.explode_outer("terms").alias("t")).filter("t != ''").groupBy(F.xxhash64("t").alias("term")).agg(F.sum("w").alias("df"))
    kept = counted.filter(F.col("df").between(max(2 * UNIT, low * n), high * n)).select("term", mask_of(F.xxhash64("term", F.lit(7))).alias("mask"), "df")
    return kept.drop("df").union(docs.sparkSession.range(1).select(F.xxhash64(F.lit("")).alias("term"), F.lit(None).cast("long").alias("mask")))


def _up_to(bounds: Column, x: Column) -> Column:
    return F.size(F.filter(bounds, lambda b: b <= x))


def _bounds(rows: DataFrame, n: int, groups: list[str]) -> DataFrame:
    """groups, bounds: n quantiles of the ids, or fewer, ascending."""
    shares = F.array(*[F.lit((k + 1) / (n + 1)) for k in range(n)])
    return rows.groupBy(*groups).agg(F.array_sort(F.array_distinct(F.percentile_approx("id", shares, 10 * n))).alias("bounds"))


def with_bucket(docs: DataFrame) -> DataFrame:
    """Adds `place` (descending with the id, nulls last), `tie` (a hash of the text) and `bucket`, a triple of numbers that ascend with the id, and descend with the tie.

    The first two are quantiles of the ids, and of those within such a part: buckets are about equally large. Where one
    id, or rows without one, fill more than a bucket, that id has buckets of its own, which the third number deals by ties.
    """
    place = F.coalesce(F.bitwise_not(F.col("doc_id")), F.lit((1 << 63) - 1))
    docs = docs.withColumns({"place": place, "id": F.coalesce("doc_id", F.lit(-(1 << 63))), "tie": F.xxhash64("text")})
    ids = docs.select("id")
    n = ids.count()
    wanted = min(STEP * STEP, n // BUCKET_DOCS + 1)
    if wanted == 1:
        return docs.withColumn("bucket", F.struct(*[F.lit(0).alias(c) for c in ("part", "within", "piece")])).drop("id")
    first = min(STEP, round(wanted**0.5))
    tops = F.from_json(F.lit(json.dumps(_bounds(ids, first, []).first()["bounds"])), "array<bigint>")
    part = _up_to(tops, F.col("id")).alias("part")
    # ids that fill more than a bucket, STEP^2 at most
    large = ids.groupBy("id").count().filter(F.col("count") > max(BUCKET_DOCS, n // (STEP * STEP)))
    large = cut_lineage(large.select(part, "id", F.ceil(F.col("count") / BUCKET_DOCS).alias("_pieces")))
    edges = large.select("part", F.explode(F.array("id", F.when(F.col("id") < (1 << 63) - 1, F.col("id") + 1))).alias("id")).groupBy("part").agg(F.collect_set("id").alias("more"))
    second = _bounds(ids.select(part, "id"), -(-wanted // first), ["part"]).join(edges, "part", "left")
    second = cut_lineage(second.select("part", F.array_sort(F.array_union("bounds", F.coalesce("more", F.array().cast("array<bigint>")))).alias("bounds")))
    rows = docs.withColumn("part", part).join(F.broadcast(second), "part").withColumn("within", _up_to(F.col("bounds"), F.col("id"))).drop("bounds")
    share = (F.col("tie") / F.lit(2.0**64) + 0.5) * F.col("_pieces")
    rows = rows.join(F.broadcast(large.drop("part")), "id", "left").withColumn("piece", -F.coalesce(F.floor(share), F.lit(0)).cast("int"))
    return rows.withColumn("bucket", F.struct("part", "within", "piece")).drop("id", "part", "within", "piece", "_pieces")


def in_order(docs: DataFrame) -> DataFrame:
    """bucket, n (the place within), extra, doc_id, text, following: the text of the next document by descending id, after the last one the first.

    Each bucket is a window of its own and ends with a copy (extra) of the row that follows its last one, from the next
    lower bucket; so no window holds all rows. Rows that share an id are in the order of a hash of their texts.
    """
    rows = with_bucket(docs)
    # a row for each bucket, STEP^2 and a few at most: in one window, numbered, and broadcast
    heads = rows.groupBy("bucket").agg(F.min(F.struct("place", "tie")).alias("head"))
    w = Window.orderBy(F.desc("bucket"))
    heads = cut_lineage(heads.select("bucket", "head", F.row_number().over(w).alias("number")))
    last = heads.agg(F.max("number")).first()[0] or 1
    heads = heads.withColumn("to_number", F.when(F.col("number") == 1, last).otherwise(F.col("number") - 1))
    sent = rows.join(F.broadcast(heads), "bucket").withColumn("to_bucket", F.when((F.col("place") == F.col("head.place")) & (F.col("tie") == F.col("head.tie")), F.col("to_number")))
    sent = sent.drop("bucket").withColumnRenamed("number", "bucket")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("extra"))
    copy = F.struct(F.col("to_bucket").alias("bucket"), F.lit(True).alias("extra"))
    sent = sent.select("doc_id", "text", "place", "tie", F.when(F.col("to_bucket").isNull(), F.array(own)).otherwise(F.array(own, copy)).alias("at"))
    sent = sent.select("doc_id", "text", "place", "tie", F.explode("at").alias("at"))
    sent = sent.select("at.bucket", "at.extra", "place", "tie", "doc_id", "text")
    w = Window.partitionBy("bucket").orderBy("extra", "place", "tie")
    return sent.select("bucket", F.row_number().over(w).alias("n"), "extra", "doc_id", "text", F.lead("text").over(w).alias("following"))


def slots(found: Column) -> Column:
    """The hash of each slot, from the sorted array of (term, mask) of a text. Most slots are empty, which the masks of all terms together tell at once."""
    shown = lambda x: F.lpad(F.hex(F.xxhash64(F.transform(x, lambda y: y["term"])).bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")

    def all_of(f: Column) -> Column:
        x, filled = f["x"], f["filled"]
        bit = lambda mask, slot: mask.bitwiseAND(F.lit(1 << slot).cast("long")) != 0
        one = lambda slot: F.filter(x, lambda y: bit(y["mask"], slot))
        return F.concat_ws(",", shown(x), *[F.when(bit(filled, s), shown(one(s))).otherwise("-") for s in range(1, SLOTS)])

    union = F.aggregate(found, F.lit(0).cast("long"), lambda acc, y: acc.bitwiseOR(y["mask"]))
    return let(F.struct(found.alias("x"), union.alias("filled")), all_of)


def likeness(a: Column, b: Column) -> Column:
    x, y = F.split(a, ","), F.split(b, ",")
    both = F.zip_with(x, y, lambda p, q: F.struct(F.coalesce(p, F.lit("-")).alias("p"), F.coalesce(q, F.lit("-")).alias("q")))
    filled = F.filter(both, lambda s: (s["p"] != "-") | (s["q"] != "-"))
    same = F.filter(filled, lambda s: s["p"] == s["q"])
    return F.when(a == b, F.lit(1.0)).otherwise(F.size(same) / F.greatest(F.size(filled), F.lit(1)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """For every document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last half replaced by as much of the beginning of the next document. A null text counts as
    empty; of repeated rows each is a document.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = cut_lineage(lexicon(docs, low, high))
    few = words.count() <= MOST_TERMS
    half = F.floor(F.length("text") / 2).cast("int")
    rows = in_order(docs).withColumn("edited", F.when(F.col("extra"), "").otherwise(F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("following"), F.lit(1), half))))
    info = F.struct(F.col("doc_id").alias("doc_id"), F.col("extra").alias("extra"), F.length("text").alias("n_chars"), F.when(~F.col("extra"), F.sha2(F.col("edited"), 256)).alias("edited_sha256"))
    sides = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.col(c).alias("text")) for side, c in ((0, "text"), (1, "edited"))])).alias("s")
    rows = rows.select("bucket", "n", info.alias("info"), "text", "edited").select("bucket", "n", "info", sides).select("bucket", "n", "s.side", "info", "s.text", terms(F.col("s.text")).alias("terms"))
    # each term is a row; the first, which stands for the text itself, carries what is needed of it. There is always one, and
    # by an outer explode Spark doesn't cut the text a second time to test that
    rows = rows.select("bucket", "n", "side", "info", "text", F.posexplode_outer("terms").alias("place", "t"))
    first = F.col("place") == 0
    rows = rows.select("bucket", "n", "side", F.when(first, F.col("info")).alias("info"), F.when(first, F.col("text")).alias("text"), F.xxhash64("t").alias("term"))
    rows = rows.join(F.broadcast(words) if few else words, "term")
    found = F.sort_array(F.collect_list(F.when(F.col("mask").isNotNull(), F.struct(F.col("term").alias("term"), F.col("mask").alias("mask")))))
    per = rows.groupBy("bucket", "n", "side").agg(found.alias("found"), F.max("info").alias("info"), F.max("text").alias("text"))
    # a text without any term of the lexicon: all its terms
    of_term = lambda t: let(F.xxhash64(t), lambda h: F.named_struct(F.lit("term"), h, F.lit("mask"), let(F.xxhash64(h, F.lit(7)), mask_of)))
    spare = F.transform(F.filter(terms(F.col("text")), lambda t: t != ""), of_term)
    shown = F.when(F.size("found") > 0, F.col("found")).otherwise(F.sort_array(spare))
    fp = let(shown, lambda x: F.when(F.size(x) == 0, F.concat(F.lit("text:"), F.hex(F.xxhash64(F.lit(""))))).otherwise(slots(x)))
    per = per.select("bucket", "n", "side", "info", fp.alias("fp"))
    both = per.groupBy("bucket", "n").agg(F.max("info").alias("info"), F.max(F.when(F.col("side") == 0, F.col("fp"))).alias("fingerprint"), F.max(F.when(F.col("side") == 1, F.col("fp"))).alias("edited_fingerprint"))
    both = both.withColumn("next", F.lead("fingerprint").over(Window.partitionBy("bucket").orderBy("n"))).filter(~F.col("info.extra"))
    return both.select("info.doc_id", F.col("info.n_chars").cast("long").alias("n_chars"), "info.edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next")).alias("near_next"))
