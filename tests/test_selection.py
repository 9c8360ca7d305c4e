"""Percentiles by narrowing, and joins by group, whatever the number and size of groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindlestat.functions import joins, selection
from spindlestat.operators import capability as cap

RNG = np.random.default_rng(12)
SHARES = (0.0, 0.25, 0.5, 0.75, 0.999, 1.0)
SERIES = {
    "normal": RNG.normal(size=3000), "wide": RNG.normal(size=2500) * 10.0 ** RNG.integers(-200, 200, 2500), "ties": RNG.integers(0, 5, 4000).astype(float), "equal": np.full(900, 7.5), "far": np.r_[np.zeros(1500), 1e300, -1e300, np.arange(1500.0)],
    "small": RNG.normal(size=40), "two": np.array([1.0, 4.0]), "one": np.array([3.0]), "steps": np.repeat([1.0, 2.0], 700),
}


@pytest.fixture(scope="module")
def rows(spark):
    found = [(g, float(x), 5) for g, v in SERIES.items() for x in v] + [("normal", None, 1), ("nothing", None, 1), (None, 2.0, 1)]
    return spark.createDataFrame(found, "g string, value double, k int").repartition(5).cache()


@pytest.mark.parametrize("most", [1 << 16, 300, 20])
def test_percentiles_equal_numpy(rows, most):
    got = {r.g: r.q for r in selection.percentiles(rows, "value", SHARES, ["g"], most).collect()}
    assert got.keys() == SERIES.keys()
    for g, v in SERIES.items():
        assert np.allclose(got[g], np.percentile(v, [100 * s for s in SHARES]), rtol=1e-12, atol=0), g


def test_percentiles_of_one_series(rows):
    v = np.concatenate(list(SERIES.values()))
    got = selection.percentiles(rows.filter("g IS NOT NULL"), "value", SHARES, (), 100).collect()
    assert len(got) == 1 and np.allclose(got[0].q, np.percentile(v, [100 * s for s in SHARES]), rtol=1e-12, atol=0)
    assert selection.percentiles(rows.filter("1 = 0"), "value", (0.5,), ["g"]).count() == 0


def test_no_bracket_holds_many_values(rows):
    known = rows.filter("value IS NOT NULL AND g IS NOT NULL").select("g", F.col("value").alias("x"))
    sizes = known.groupBy("g").agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    found = selection.brackets(known, sizes, SHARES, ["g"], 50).collect()
    assert len(found) == 2 * len(SERIES) * len(SHARES) and all(r.within <= 50 or r.low == r.high for r in found)
    for r in found:
        v = SERIES[r.g]
        below = v <= r.low if r.low_open else v < r.low
        assert below.sum() == r.before and (~below & (v < r.high if r.high_open else v <= r.high)).sum() == r.within and r.before <= r["rank"] < r.before + r.within


def test_a_sketch_that_errs_does_no_harm(rows, monkeypatch):
    """Grids that lie beyond the ranks: brackets are moved back, and what is left is ranked."""
    monkeypatch.setattr(selection, "ROUNDS", 3)
    monkeypatch.setattr(selection.F, "percentile_approx", lambda c, shares, accuracy: F.transform(F.sequence(F.lit(0), F.lit(len(shares) - 1)), lambda i: F.max(c) - i * 0))
    got = selection.percentiles(rows.filter("g = 'normal'"), "value", (0.25, 0.5), ["g"], 100).first()
    assert np.allclose(got.q, np.percentile(SERIES["normal"], [25, 50]))


def test_box_plot_of_large_and_small_groups(rows, monkeypatch):
    monkeypatch.setattr(cap, "percentiles", lambda *a: selection.percentiles(*a, 64))
    got = {r.g: r for r in cap.box_plot(rows, "value", ["g"]).collect()}
    assert got.keys() == {*SERIES, "nothing"} and got["nothing"].median is None
    for g, v in SERIES.items():
        assert np.allclose([got[g].q1, got[g].median, got[g].q3], np.percentile(v, [25, 50, 75]), rtol=1e-12, atol=0)
    assert np.isclose(cap.box_plot(rows.filter("g = 'ties'"), "value").first().median, 2)


@pytest.mark.parametrize("most", [10_000, 3, 1])
def test_joins_with_groups(spark, rows, monkeypatch, most):
    """All groups broadcast; or only those with most rows."""
    monkeypatch.setattr(joins, "GATHERED", most)
    means = rows.groupBy("g").agg(F.avg("value").alias("mean")).filter("g <> 'one'")
    got = joins.with_group(rows, means, ["g"])
    want = {g: len(v) + (g == "normal") for g, v in SERIES.items() if g != "one"} | {"nothing": 1}
    assert {r.g: r["count"] for r in got.groupBy("g").count().collect()} == want
    assert got.filter("g = 'equal' AND mean = 7.5").count() == 900
    whole = joins.with_group(rows, rows.agg(F.max("k").alias("most")), [])
    assert whole.count() == rows.count() and whole.first().most == 5


def test_few_groups_cost_no_shuffle_of_rows(spark, rows):
    """With static estimates as for large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")
    try:
        found = cap.histogram(rows, "value", ["g"])
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        final = plan.split("Initial Plan")[0]
        assert final.count("Exchange hashpartitioning") == 1 and "partial_count" in final  # of bins, counted by task first
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
