"""Best-fit packing of documents into fixed-length training sequences, under conflicts.

A document longer than the capacity is cut into full pieces and a rest; each full piece is a sequence by itself. Rests
and shorter documents are placed longest first: open bins are kept in the order of their free room, the search starts at
the successor of the document's length and goes on to the tightest bin with which the document has no conflict. Each
bin carries a bitmap of its sources and one of its duplicate clusters: a bin takes at most `per_source` documents of one
source, and no two of one cluster. Where no open bin fits, a new one is opened; so every row is placed.

Documents are dealt to shards by a hash of their id and of their number among rows of the same id. A shard holds about
`per_shard` documents, whatever the corpus, and is packed by one task; an id, source or cluster that holds much of the
corpus is spread over all shards like any other.

Null lengths, and lengths below 1, take no room (they still get a bin); a null source or cluster conflicts with nothing;
ties in length go by id, then by copy; rows that repeat an id, or lack one, are documents of their own, numbered by length,
source and cluster. (doc_id, copy, piece) is unique.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.ordering import positions
from .common import cut_lineage, few

SCHEMA = "doc_id long, copy long, piece int, n_pieces int, shard long, bin_id string, position int, start int, length int"


def conflict_masks(keys: Sequence, limit: int) -> list[list[int]]:
    """For each item, the bitmaps of which a bin may hold at most one each: `limit` lanes (bits) for each key that occurs more often than `limit`; no lanes, no conflict."""
    counts = Counter(k for k in keys if k is not None and k == k)
    first: dict = {}
    for k, n in counts.items():
        if n > limit:
            first[k] = len(first) * limit
    return [[1 << (first[k] + lane) for lane in range(limit)] if k in first else [] for k in keys]


def best_fit(lengths: Sequence[int], sources: Sequence, clusters: Sequence, capacity: int, per_source: int = 1) -> list[tuple[int, int, int]]:
    """(bin, position, start) of each item; items are placed in the given order."""
    source_lanes, cluster_lanes = conflict_masks(sources, per_source), conflict_masks(clusters, 1)
    room: list[tuple[int, int]] = []  # (free, bin), in order
    held: list[list[int]] = []  # of each bin: source bitmap, cluster bitmap, items, used
    out = []
    for length, lanes, cluster in zip(lengths, source_lanes, cluster_lanes, strict=True):
        mine = cluster[0] if cluster else 0
        at = bisect_left(room, (length, -1))
        while at < len(room):
            bin_ = held[room[at][1]]
            lane = next((x for x in lanes if not bin_[0] & x), 0) if lanes else 0
            if not bin_[1] & mine and (lane or not lanes):
                free, number = room.pop(at)
                break
            at += 1
        else:
            free, number, lane = capacity, len(held), lanes[0] if lanes else 0
            held.append(bin_ := [0, 0, 0, 0])
        out.append((number, bin_[2], bin_[3]))
        bin_[0], bin_[1], bin_[2], bin_[3] = bin_[0] | lane, bin_[1] | mine, bin_[2] + 1, bin_[3] + length
        insort(room, (free - length, number))
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", length_col: str = "length", source_col: str = "source", cluster_col: str = "cluster", capacity: int = 2048, per_source: int = 4, per_shard: int = 4096) -> DataFrame:
    """A row for each piece of each document: its bin, its place there and the offset where it starts.

    doc_id, copy (0, 1, ... among rows of one id), piece, n_pieces, shard, bin_id, position, start, length.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.greatest(F.coalesce(F.col(length_col), F.lit(0)), F.lit(0)).cast("long").alias("length"), F.col(source_col).cast("string").alias("source"), F.col(cluster_col).cast("string").alias("cluster"))
    # written once, so that numbers of rows hold
    rows = cut_lineage(rows.withColumns({"_key": F.coalesce("doc_id", F.lit(-(1 << 63))), "_row": F.monotonically_increasing_id()}))
    n_shards = max(1, -(-rows.count() // per_shard))
    repeated = rows.groupBy("_key").count().filter("count > 1").select("_key")
    numbered = rows.withColumn("copy", F.lit(0).cast("long"))
    if not repeated.isEmpty():
        repeated = few(cut_lineage(repeated))
        copies = positions(rows.join(repeated, "_key", "left_semi"), ["length", "source", "cluster", "_row"], ["_key"], "copy")
        numbered = numbered.join(repeated, "_key", "left_anti").unionByName(copies.withColumn("copy", F.col("copy") - 1))
    rows = numbered.drop("_key", "_row").withColumn("shard", F.pmod(F.xxhash64("doc_id", "copy"), F.lit(n_shards)))

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "copy"], kind="stable")
        whole, rest = part.length // capacity, part.length % capacity
        n = (whole + ((rest > 0) | (whole == 0))).astype(int)
        full = part.loc[part.index.repeat(whole)]
        full = pd.DataFrame({"doc_id": full.doc_id, "copy": full["copy"], "piece": full.groupby(level=0).cumcount(), "n_pieces": n.repeat(whole), "position": 0, "start": 0, "length": capacity})
        full["bin"] = range(len(full))
        last = part[(rest > 0) | (whole == 0)].copy()
        last["piece"], last["n_pieces"], last["length"] = whole, n, rest
        last = last.sort_values(["length", "doc_id", "copy"], ascending=[False, True, True], kind="stable")
        text = lambda s: [None if x is None or x != x else x for x in s]
        placed = best_fit(last.length.tolist(), text(last.source), text(last.cluster), capacity, per_source)
        last["bin"], last["position"], last["start"] = zip(*placed, strict=True) if placed else ((), (), ())
        last["bin"] = last["bin"].astype(int) + len(full)
        out = pd.concat([full, last[full.columns]]) if len(full) else last
        shard = int(part.shard.iloc[0])
        return out.assign(shard=shard, bin_id=[f"{shard}-{b}" for b in out["bin"]])[[x.split()[0] for x in SCHEMA.split(", ")]]

    return rows.groupBy("shard").applyInPandas(packed, SCHEMA)


def with_clusters(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds `cluster`, which copies of a text share whatever their white space and ASCII case (near copies don't: their clusters are the components of minhash.near_duplicates, which pack() takes as well), and `length`, the words plus one for the end."""
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[\x20\x09-\x0D]+", " "))
    return docs.withColumn("_words", words).withColumn("cluster", F.when(F.col("_words") != "", F.xxhash64("_words"))).withColumn("length", F.when(F.col("_words") == "", 1).otherwise(F.length("_words") - F.length(F.replace(F.col("_words"), F.lit(" "), F.lit(""))) + 2)).drop("_words")
