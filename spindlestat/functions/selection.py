"""Exact percentiles of large groups: brackets about the wanted ranks are narrowed until few values are left in them.

A group of up to MOST values is sorted by one aggregate. For a larger one, each wanted rank has a bracket of values, from
the least to the greatest at first. In each round, a mergeable sketch of the values in the bracket gives a grid of
quantiles, and two of them that lie about the rank with some room to spare divide the bracket. How many values lie below,
at, between and above the two is then counted exactly. So the rank is known to be that of one of the two values, or in
which of the open intervals it lies, and an error of the sketch can't lead to a wrong result. A round makes a bracket about
30 times narrower, whatever the distribution; ties are found at once. What is left in a bracket, MOST values at most, is
ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .joins import settled, with_group

#: Values that a task may hold of one group; parts of the grid; rounds (each narrows 30 times, and MOST * 30^12 is beyond any table).
MOST, GRID, ROUNDS = 1 << 16, 128, 12


def _in(t: Column, x: Column) -> Column:
    """Whether x lies in the bracket t, whose ends may be open."""
    return ((x > t["low"]) | ((x == t["low"]) & ~t["low_open"])) & ((x < t["high"]) | ((x == t["high"]) & ~t["high_open"]))


def _inside(rows: DataFrame, targets: DataFrame, groups: Sequence[str], *more: str) -> DataFrame:
    """groups, x, k, end, more: each value with the targets in whose bracket it lies."""
    fields = ("k", "end", "low", "high", "low_open", "high_open", *more)
    per = targets.groupBy(*groups).agg(F.collect_list(F.struct(*fields)).alias("_targets"))  # a few in each group
    found = with_group(rows, per, groups).withColumn("t", F.explode(F.filter("_targets", lambda t: _in(t, F.col("x")))))
    return found.select(*groups, "x", *[F.col(f"t.{c}").alias(c) for c in ("k", "end", *more)])


def _narrower(rows: DataFrame, targets: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The targets with narrower brackets."""
    keys = [*groups, "k", "end"]
    shares = [j / GRID for j in range(GRID + 1)]
    grids = _inside(rows, targets, groups).groupBy(*keys).agg(F.percentile_approx("x", shares, 10 * GRID).alias("grid"))
    r = F.col("rank") - F.col("before")  # within the bracket
    place = F.floor(r / F.col("within") * GRID).cast("int")
    tried = settled(targets.join(grids, keys).withColumns({"p": F.get("grid", F.greatest(place - 1, F.lit(0))), "q": F.get("grid", F.least(place + 2, F.lit(GRID)))}).drop("grid"))
    x, p, q = F.col("x"), F.col("p"), F.col("q")
    counted = _inside(rows, tried, groups, "p", "q").groupBy(*keys).agg(F.count_if(x < p).alias("under"), F.count_if(x <= p).alias("upto"), F.count_if(x < q).alias("under_q"), F.count_if(x <= q).alias("upto_q"))
    out = tried.join(counted, keys)
    # (where, low, high, whether they are open, values of the bracket before these, values in these)
    own_low, own_high, zero = (F.col("low"), F.col("low_open")), (F.col("high"), F.col("high_open")), F.lit(0).cast("long")
    open_, closed = F.lit(True), F.lit(False)
    cases = [
        (r < F.col("under"), own_low, (p, open_), zero, F.col("under")),
        (r < F.col("upto"), (p, closed), (p, closed), F.col("under"), F.col("upto")),
        (r < F.col("under_q"), (p, open_), (q, open_), F.col("upto"), F.col("under_q")),
        (r < F.col("upto_q"), (q, closed), (q, closed), F.col("under_q"), F.col("upto_q")),
        (F.lit(True), (q, open_), own_high, F.col("upto_q"), F.col("within")),
    ]
    found = F
    for where, (low, low_open), (high, high_open), start, stop in cases:
        found = found.when(where, F.struct(low.alias("low"), low_open.alias("low_open"), high.alias("high"), high_open.alias("high_open"), (F.col("before") + start).alias("before"), (stop - start).alias("within")))
    return settled(out.withColumn("_new", found).withColumns({c: F.col(f"_new.{c}") for c in ("low", "low_open", "high", "high_open", "before", "within")}).select(*targets.columns))


def brackets(rows: DataFrame, sizes: DataFrame, shares: Sequence[float], groups: Sequence[str] = (), most: int = MOST) -> DataFrame:
    """Two rows for each group of sizes (n, low, high) and share, one for the rank below its position and one for that above (end 0, 1).

    k, end, position, rank (from 0), the bracket low, high, low_open, high_open, before (values of the group below the
    bracket), and within (values in it): `most` at most, or all equal, with low = high.
    """
    k = F.posexplode(F.array(*[F.lit(float(s)) for s in shares])).alias("k", "share")
    targets = sizes.select(*groups, "n", "low", "high", k).withColumn("position", (F.col("n") - 1) * F.col("share"))
    targets = targets.select("*", F.posexplode(F.array(F.floor("position"), F.ceil("position"))).alias("end", "rank"))
    targets = targets.withColumns({"low_open": F.lit(False), "high_open": F.lit(False), "before": F.lit(0).cast("long"), "within": F.col("n")}).drop("n", "share")
    targets = settled(targets)
    wide = (F.col("within") > most) & (F.col("low") < F.col("high"))
    for _ in range(ROUNDS):
        if targets.filter(wide).isEmpty():
            break
        targets = settled(targets.filter(~wide).unionByName(_narrower(rows, settled(targets.filter(wide)), groups)))
    return targets


def percentiles(df: DataFrame, value: str, shares: Sequence[float], groups: Sequence[str] = (), most: int = MOST) -> DataFrame:
    """groups, q: the exact percentiles of each group, linear between neighbours; missing values don't count. No task holds more than `most` values of a group."""
    rows = df.dropna(subset=list(groups)) if groups else df
    rows = rows.select(*groups, F.col(value).cast("double").alias("x")).filter("x IS NOT NULL")
    wanted = F.percentile("x", F.array(*[F.lit(float(s)) for s in shares])).alias("q")
    sizes = settled(rows.groupBy(*groups).agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")))
    large, small = sizes.filter(F.col("n") > most), sizes.filter(F.col("n") <= most)
    if large.isEmpty():
        return rows.groupBy(*groups).agg(wanted)
    found = brackets(rows, large, shares, groups, most)
    ranked = _inside(rows, found.filter("low < high"), groups)
    ranked = ranked.withColumn("i", F.row_number().over(Window.partitionBy(*groups, "k", "end").orderBy("x")) - 1)
    at = found.join(ranked, [*groups, "k", "end"], "left").groupBy(*groups, "k", "position")
    picked = F.when(F.col("low") == F.col("high"), F.col("low")).when(F.col("i") + F.col("before") == F.col("rank"), F.col("x"))
    a, b = (F.max(F.when(F.col("end") == end, picked)) for end in (0, 1))
    part = F.col("position") - F.floor("position")
    at = at.agg(a.alias("a"), b.alias("b")).withColumn("q", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1 - part) * F.col("a") + part * F.col("b")))
    out = at.groupBy(*groups).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "q"))), lambda s: s["q"]).alias("q"))
    if not groups:
        return out
    return out.unionByName(with_group(rows, small.select(*groups), groups).groupBy(*groups).agg(wanted))
