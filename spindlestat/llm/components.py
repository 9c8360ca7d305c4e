"""Connected components of a link table, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import BROADCAST_ROWS, cut_lineage

#: A node is heavy from so many links on, and if it has this share of all. So there are few heavy nodes, whatever the table.
HEAVY_LINKS, HEAVY_SHARE = 256, 1e-4


def with_heavy(rows: DataFrame, key: str | list[str], found: DataFrame, n_rows: int, degree: str = "n") -> DataFrame:
    """rows joined with `found`, which has each key once and the number of its rows in `degree`; no task gets all rows of a heavy key.

    Heavy keys have more than HEAVY_SHARE of the n_rows rows each, so there are at most 1 / HEAVY_SHARE of them: they are
    broadcast, and their rows stay where they are. The rows of all other keys are joined by shuffle.
    """
    least = max(HEAVY_LINKS, int(n_rows * HEAVY_SHARE))
    heavy = F.broadcast(found.filter(F.col(degree) > least).drop(degree))
    light = found.filter(F.col(degree) <= least).drop(degree)
    return rows.join(heavy, key).unionByName(rows.join(heavy, key, "left_anti").join(light, key))


def with_found(rows: DataFrame, key: str | list[str], found: DataFrame, n_rows: int, degree: str = "n") -> DataFrame:
    """with_heavy(), of a table that is written first and broadcast as a whole if it has few rows."""
    found = cut_lineage(found)
    return rows.join(F.broadcast(found.drop(degree)), key) if found.count() <= BROADCAST_ROWS else with_heavy(rows, key, found, n_rows, degree)


def _with_least(rows: DataFrame, n_rows: int) -> DataFrame:
    """(a, b, m): m is the smallest b of each a. Up to BROADCAST_ROWS rows have so many a at most, and these are broadcast."""
    found = rows.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    return rows.join(F.broadcast(found.drop("n")), "a") if n_rows <= BROADCAST_ROWS else with_heavy(rows, "a", found, n_rows)


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rows = _with_least(both, 2 * n).withColumn("m", F.least("m", "a"))
    return rows.filter("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """edges point down: a > b."""
    rows = _with_least(edges, n)
    return rows.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); a component is named by its smallest node.

    Links of a node with itself or with null tell nothing and are dropped; without links the result is empty. A node may
    have any number of links: what is grouped by node is summed up before it travels, and the links of heavy nodes are
    joined with a small broadcast table. Each round ends in a checkpoint; rounds are few, about the logarithm of the
    widest component.
    """
    now = cut_lineage(edges.select("a", "b").filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        large = _large_star(now, seen[0])
        mark, now = seen, cut_lineage(_small_star(large, seen[0]))
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
