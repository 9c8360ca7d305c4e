"""Near-duplicates by HyperMinHash: compressed registers are banded, candidates are estimated, and links are confirmed.

1. Every text becomes its set of word shingles and 240 registers of 8 bits. Texts with equal sets are one node from here on.
2. Nodes that share a band (6 registers, all equal and not all empty; 40 bands) are candidates. At a similarity of 0.8 a
   pair shares no band with a probability of 5e-6. Buckets, however large, give a link from each member to the smallest;
   the components of these links are clusters, which hold every candidate pair.
3. Bands also collide by chance, and in a large corpus such chains could join all of it. So clusters of more than WHOLE
   blocks are refined by estimates (see refined()), and only what is still together is compared.
4. Clusters are compared block against block: a block has about BLOCK_DOCS sets and BLOCK_SHINGLES shingles, so that a
   task's memory is bounded, whatever the size of a cluster; no pair becomes a row. Within two blocks, pairs whose
   collision-corrected estimate is below the threshold by more than SLACK standard errors are left, as are pairs that are
   connected already; the others are confirmed on the full sets. A task returns a spanning forest of its links.
5. The components of these links are the result.

Links are exact: 100 * intersection >= percent * union, on 64-bit shingle hashes. A text without words is linked with
nothing. Each row is a document: rows that repeat an id are each in the component of their own text, and a row with a null
id is too. A component is named by the smallest id in it, null if none of its rows has an id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import shingles as sh
from .common import cut_lineage, few, raw, record, slices, unused
from .components import components, with_found, with_heavy

BLOCK_DOCS, BLOCK_SHINGLES, SLACK = 384, 150_000, 5.0
#: Estimates from which two nodes stay in one cluster, and from which one stands for the other, and the rounds of refining.
LOOSE, TIGHT, ROUNDS = 0.47, 0.9, 2
#: Clusters of more blocks are refined; up to there, all blocks of a cluster are compared, 36 pairs of them.
WHOLE = 8
NO_ID = (1 << 63) - 1


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, key, n (size of the set), h1, h2 (a 128-bit hash of the set), registers."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("registers", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = sh.Shingler(words)
        for batch in slices(batches):
            sets = [shingler(t) for t in raw(batch)]
            halves = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
            yield record(schema, doc_id=batch.column("doc_id"), key=batch.column("key"), n=[len(s) for s in sets], h1=pa.array(halves[:, 0]), h2=pa.array(halves[:, 1]), registers=[sh.registers(s).tobytes() for s in sets])

    return docs.mapInArrow(run, "doc_id long, key long, n long, h1 long, h2 long, registers binary")


def band_rows(sets: DataFrame) -> DataFrame:
    """(bucket, node) for each band of each node."""
    bands = f"transform(sequence(0, {sh.BANDS - 1}), i -> struct(i as i, substring(registers, i * {sh.BAND} + 1, {sh.BAND}) as part))"
    rows = sets.select("node", F.explode(F.expr(bands)).alias("band")).filter(F.col("band.part") != F.lit(bytes(sh.BAND)))
    return rows.select(F.xxhash64("band.i", "band.part").alias("bucket"), "node")


def led(rows: DataFrame, n_rows: int) -> DataFrame:
    """(bucket, node, leader): the nodes of buckets with several, and the smallest of each bucket."""
    found = rows.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("_most"), F.count(F.lit(1)).alias("n"))
    return with_found(rows, "bucket", found.filter(F.col("leader") < F.col("_most")).drop("_most"), n_rows)


def candidate_links(rows: DataFrame, n_rows: int) -> DataFrame:
    """(a, b): each node of a bucket with the bucket's smallest."""
    return led(rows, n_rows).filter("node != leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()


def estimated(pairs: DataFrame, sets: DataFrame, n_pairs: int) -> DataFrame:
    """(a, b, guess): the similarity of two nodes by their registers."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("guess", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, sh.REGISTERS) for c in ("_left", "_right"))
                chance = np.array([sh.collisions(n // sh.BUCKETS, n // sh.BUCKETS) for n in batch.column("n").to_pylist()])
                yield record(schema, a=batch.column("a"), b=batch.column("b"), guess=sh.estimate(left, right, chance)[0])

    members = sets.select(F.col("node").alias("a"), F.col("registers").alias("_left"), "n")
    degrees = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("_degree"))
    tops = degrees.join(sets.select(F.col("node").alias("b"), F.col("registers").alias("_right")), "b")
    return with_heavy(pairs.join(members, "a"), "b", tops, n_pairs, "_degree").select("a", "b", "n", "_left", "_right").mapInArrow(run, "a long, b long, guess double")


def refined(sets: DataFrame) -> DataFrame:
    """(node, cluster) of nodes that estimates keep together.

    In each bucket the smallest node leads, and all others are estimated against it. From LOOSE on a node stays with the
    leader; from TIGHT on it also leaves the bucket, as does the leader; then the next one leads. What is linked to a node
    that left (similarity 0.8) is similar to its leader by 0.6 at least, as distances add up, and LOOSE is four standard
    errors below that, so it stays with the same leader. Nodes left in a bucket after ROUNDS rounds stay together.
    """
    rows = band_rows(sets)
    n, links = sh.BANDS * sets.count(), []
    for _ in range(ROUNDS):
        following = cut_lineage(led(rows, n).filter("node != leader"))
        pairs = following.select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
        n = following.count()
        if not n:
            return components(_union(links)).withColumnRenamed("component", "cluster")
        known = cut_lineage(estimated(pairs, sets, n).filter(F.col("guess") >= LOOSE))
        links.append(known.select("a", "b"))
        tight = known.filter(F.col("guess") >= TIGHT).select(F.col("a").alias("node"), F.col("b").alias("leader"))
        rows = following.join(few(tight), ["node", "leader"], "left_anti").select("bucket", "node")
    return components(_union([*links, candidate_links(rows, n)])).withColumnRenamed("component", "cluster")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


class Forest:
    """Union-find over 0 .. n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def compare(registers: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows of `left` and of `right` (the same array: within it).

    Rows that the forest already connects are not compared. Of the others, the one of the highest estimate is confirmed
    first: in a group of near copies it connects all; where that fails, all that are left are confirmed at once.
    """
    size = np.array([len(s) for s in sets])
    label = np.arange(len(sets))
    flat: tuple[np.ndarray, np.ndarray] | None = None
    out: list[tuple[int, int]] = []
    threshold = percent / 100
    chances: dict[int, float] = {}

    def connect(a: int, b: int) -> None:
        if label[a] != label[b]:
            out.append((a, b))
            label[label == label[b]] = label[a]

    for i, a in enumerate(left.tolist()):
        open_ = right[i + 1 :] if left is right else right
        open_ = open_[label[open_] != label[a]]
        open_ = open_[(size[open_] >= threshold * size[a]) & (threshold * size[open_] <= size[a])]
        if not len(open_):
            continue
        per = int(size[a]) // sh.BUCKETS
        if per not in chances:
            chances[per] = sh.collisions(per, per)
        guess, used = sh.estimate(registers[a], registers[open_], chances[per])
        near = guess >= threshold - SLACK * np.sqrt(0.25 / np.maximum(used, 1))
        open_, guess = open_[near], guess[near]
        while len(open_):
            best = int(open_[guess.argmax()])
            common = len(np.intersect1d(sets[a], sets[best], assume_unique=True))
            if 100 * common < percent * (size[a] + size[best] - common):
                break
            connect(a, best)
            apart = label[open_] != label[a]
            open_, guess = open_[apart], guess[apart]
        if not len(open_):
            continue
        if flat is None:
            shingles, owner = np.concatenate([sets[r] for r in right]), np.repeat(right, size[right])
            order = np.argsort(shingles, kind="stable")
            flat = shingles[order], owner[order]
        start, stop = np.searchsorted(flat[0], sets[a]), np.searchsorted(flat[0], sets[a], side="right")
        runs = stop - start
        places = np.arange(int(runs.sum())) + np.repeat(start - (np.cumsum(runs) - runs), runs)
        common = np.bincount(flat[1][places], minlength=len(sets))[open_]
        for b in open_[100 * common >= percent * (size[a] + size[open_] - common)].tolist():
            connect(a, b)
    return out


def block_links(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) links found in each (cluster, i, j), whose rows (node, block, shingles, registers) come to one task, one after the other."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def of_group(group: list[tuple]) -> tuple[list[int], list[int]]:
        ids = [g[1] for g in group]
        sets, regs = [np.frombuffer(g[3], np.uint64) for g in group], np.frombuffer(b"".join(g[4] for g in group), np.uint8).reshape(len(group), -1)
        (_, i, j), block = group[0][0], np.array([g[2] for g in group])
        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        found = compare(regs, sets, left, right, percent) if len(left) and len(right) else []
        return [ids[a] for a, _ in found], [ids[b] for _, b in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            for cluster, i, j, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][0] != (cluster, i, j):
                    a, b = of_group(group)
                    yield record(schema, a=a, b=b)
                    group = []
                group.append(((cluster, i, j), *rest))
        if group:
            a, b = of_group(group)
            yield record(schema, a=a, b=b)

    placed = rows.select("cluster", "i", "j", "node", "block", "shingles", "registers").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "node")
    return placed.mapInArrow(run, "a long, b long")


def _in_blocks(member: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, cluster, n_blocks, block) of clustered nodes, materialised."""
    sizes = member.join(sets.select("node", "n"), "node").groupBy("cluster").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_shingles"))
    n_blocks = F.greatest(F.ceil(F.col("n_docs") / BLOCK_DOCS), F.ceil(F.col("n_shingles") / BLOCK_SHINGLES)).cast("int")
    placed = with_found(member, "cluster", sizes.select("cluster", "n_docs", n_blocks.alias("n_blocks")), member.count(), "n_docs").select("node", "cluster", "n_blocks")
    return cut_lineage(placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int")))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key (a hash of the text), text; a null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


def grouped(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, key, n_shingles, component (a number), first (the smallest struct(id, key) in it) of every row of _rows(); the last two are null for texts without words."""
    signed = cut_lineage(signatures(docs, words))
    oid = F.coalesce("doc_id", F.lit(NO_ID))
    sets = signed.filter("n > 0").groupBy("h1", "h2").agg(F.min(F.struct(oid.alias("id"), F.col("key").alias("key"))).alias("rep"), F.max("n").alias("n"), F.first("registers").alias("registers"), F.count(F.lit(1)).alias("copies"))
    sets = cut_lineage(sets.withColumn("node", F.monotonically_increasing_id()))  # numbers hold, as the table is written
    n_sets = sets.count()
    member = components(candidate_links(band_rows(sets), sh.BANDS * n_sets)).withColumnRenamed("component", "cluster")
    placed = _in_blocks(member, sets)
    large = placed.filter(F.col("n_blocks") > WHOLE).select("node")
    if not large.isEmpty():
        finer = refined(cut_lineage(sets.join(few(large), "node")))
        placed = placed.filter(F.col("n_blocks") <= WHOLE).unionByName(_in_blocks(finer, sets))
    # the texts of these nodes once more: the row that represents each, and one only where it is repeated
    wanted = few(cut_lineage(placed.join(sets.select("node", "rep"), "node").select("rep.id", "rep.key", "node", "cluster", "n_blocks", "block")))
    texts = docs.withColumn("id", oid).join(wanted, ["id", "key"])
    repeated = signed.groupBy(oid.alias("id"), "key").count().filter("count > 1").select("id", "key")
    if not repeated.isEmpty():
        repeated = few(cut_lineage(repeated))
        texts = texts.join(repeated, ["id", "key"], "left_anti").unionByName(texts.join(repeated, ["id", "key"], "left_semi").dropDuplicates(["node"]))
    schema = pa.schema([("cluster", pa.int64()), ("n_blocks", pa.int32()), ("node", pa.int64()), ("block", pa.int32()), ("shingles", pa.binary()), ("registers", pa.binary())])

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = sh.Shingler(words)
        for batch in slices(batches):
            sets = [shingler(t) for t in raw(batch)]
            yield record(schema, cluster=batch.column("cluster"), n_blocks=batch.column("n_blocks"), node=batch.column("node"), block=batch.column("block"), shingles=[s.tobytes() for s in sets], registers=[sh.registers(s).tobytes() for s in sets])

    rows = texts.select("cluster", "n_blocks", "node", "block", "text").mapInArrow(shingled, "cluster long, n_blocks int, node long, block int, shingles binary, registers binary")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    links = few(cut_lineage(components(block_links(rows, percent))))
    nodes = sets.select("node", "h1", "h2", "rep", "copies")
    linked = nodes.join(links, "node")
    first = linked.groupBy("component").agg(F.min("rep").alias("first"), F.count(F.lit(1)).alias("n"))
    named = with_found(linked, "component", first, n_sets).select("h1", "h2", "component", "first", "copies")
    alone = nodes.join(links, "node", "left_anti").select("h1", "h2", F.col("node").alias("component"), F.col("rep").alias("first"), "copies")
    out = with_found(signed.filter("n > 0"), ["h1", "h2"], named.unionByName(alone), signed.count(), "copies")
    columns = ["doc_id", "key", F.col("n").alias("n_shingles"), "component", "first"]
    empty = signed.filter("n = 0").withColumns({"component": F.lit(None).cast("long"), "first": F.lit(None).cast("struct<id:bigint,key:bigint>")})
    return out.select(*columns).unionByName(empty.select(*columns))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id of the component; the row's own without words), kept (whether it is that one; also true where both are null)."""
    out = grouped(_rows(docs, id_col, text_col), words, percent)
    own = F.when(F.col("first").isNull(), F.col("doc_id")).when(F.col("first.id") != NO_ID, F.col("first.id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, but one of each component: that of the smallest id (null ids last, ties by a hash of the text), and one of rows that repeat its id and text. Rows without words stay."""
    oid, key = unused(docs, "id"), unused(docs, "key")  # names that no column of docs has
    found = cut_lineage(grouped(_rows(docs, id_col, text_col), words, percent).select(F.coalesce("doc_id", F.lit(NO_ID)).alias(oid), F.col("key").alias(key), F.col("first.id").alias("_first_id"), F.col("first.key").alias("_first_key")))
    keyed = docs.withColumns({oid: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), key: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    on = [oid, key]
    gone = found.filter((F.col("_first_id") != F.col(oid)) | (F.col("_first_key") != F.col(key))).select(*on).distinct()
    out = keyed.join(few(cut_lineage(gone)), on, "left_anti")
    repeated = found.filter(F.col("_first_id").isNotNull()).groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1").select(*on)
    if not repeated.isEmpty():
        repeated = few(cut_lineage(repeated))
        out = out.join(repeated, on, "left_anti").unionByName(out.join(repeated, on, "left_semi").dropDuplicates(on))
    return out.drop(*on)
