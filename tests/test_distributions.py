"""The distribution functions in SQL, in Spark and in DuckDB, against exact forms."""

import math

import duckdb
import exact
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spindlestat.functions import special
from spindlestat.operators import capability as cap

RNG = np.random.default_rng(6)


def both(spark, frame, steps):
    """The frame with the columns of each step, by Spark and by DuckDB."""
    df = spark.createDataFrame(frame).coalesce(2)
    con = duckdb.connect()
    con.register("t0", frame)
    found = con.sql("SELECT * FROM t0")
    for k, step in enumerate(steps, 1):
        df = df.withColumns({name: F.expr(s if isinstance(s, str) else s[0]) for name, s in step.items()})
        con.register(f"t{k}", con.sql(f"SELECT *, {', '.join(f'{s if isinstance(s, str) else s[1]} AS {name}' for name, s in step.items())} FROM t{k - 1}").df())
        found = con.sql(f"SELECT * FROM t{k}")
    return df.toPandas(), found.df()


def test_students_t(spark):
    frame = pd.DataFrame([(t, float(n)) for t in (0.0, 1e-7, 0.1, -0.7, 1.0, 2.228, 4.5, -12.0, 60.0) for n in [*range(0, 45), 99, 1000, 10**6]], columns=["t", "n"])
    steps = [{"z": special.t_normal_sql("t", "n")}, {"p": special.t_two_sided_sql("t", "n", "z")}]
    for got in both(spark, frame.assign(n=frame.n.where(frame.n > 0)), steps):
        for r in got.itertuples():
            want = exact.t_two_sided(r.t, r.n)
            assert math.isnan(r.p) if math.isnan(want) else math.isclose(r.p, want, rel_tol=1e-7, abs_tol=1e-12), r
    edge = special.with_t_p_value(spark.createDataFrame([(math.inf, 5), (None, 5), (1.0, None), (1.0, 0), (-math.inf, 40)], "t double, df long"), "t", "df").toPandas()
    assert edge.p_value.tolist()[0] == edge.p_value.tolist()[4] == 0 and edge.p_value.isna().tolist() == [False, True, True, True, False]
    assert list(edge.columns) == ["t", "df", "p_value"]


def test_kolmogorov_smirnov(spark):
    frame = pd.DataFrame([(x / math.sqrt(n), float(n)) for n in (1, 2, 3, 5, 10, 20, 50, 140, 499, 500, 501, 2000, 10**6) for x in np.r_[0.0, np.linspace(0.2, 2.6, 60), 50]], columns=["d", "n"])
    forms = (special.ks_sql("d", "n"), special.ks_sql("d", "n", special.KS_ONE_SIDED_DUCKDB))
    for got in both(spark, frame, [{"p": forms}]):
        for r in got.itertuples():
            want = exact.ks_two_sided(r.d, int(r.n))
            assert abs(r.p - want) < (1e-9 if r.n > 500 else 2e-6 if want < 0.06 and r.n > 1 else 0.008 if r.n >= 5 else 0.07), (r, want)
            assert (r.p > 0.05) == (want > 0.05)
    assert spark.createDataFrame([(None, 5.0), (0.3, 0.0)], "d double, n double").select(F.expr(forms[0]).alias("p")).toPandas().p.isna().all()


@pytest.mark.parametrize("n", [3, 4, 5, 6, 7, 11, 12, 30, 800, 5000])
def test_shapiro_wilk(spark, n):
    groups = {"normal": RNG.normal(5, 2, n), "even": RNG.uniform(size=n), "skewed": RNG.exponential(size=n), "ties": RNG.integers(0, 3, n).astype(float)}
    groups["ties"][0] += 5
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v], "g string, value double")
    got = {r.g: r for r in cap.shapiro(df, "value", ["g"]).collect()}
    for g, v in groups.items():
        w, p = exact.shapiro_wilk(v)
        assert math.isclose(got[g].sw_w, w, rel_tol=1e-7) and math.isclose(got[g].sw_p, p, rel_tol=1e-4, abs_tol=1e-9), g


def test_shapiro_wilk_of_odd_groups(spark):
    df = spark.createDataFrame([("few", 1.0), ("few", 2.0), *[("equal", 2.0)] * 9, ("none", None), *[("many", float(x)) for x in range(5001)]], "g string, value double")
    got = cap.normality(df, "value", ["g"]).collect()
    assert len(got) == 4 and all(r.sw_p is None and r.sw_w is None and not r.sw_pass for r in got)
    one = cap.normality(df.filter("g = 'many'"), "value").collect()
    assert len(one) == 1 and one[0].n == 5001 and one[0].ks_p is not None


def test_no_python_runs_for_the_tests_of_fit(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(30)], "g string, value double")
    assert "Python" not in cap.normality(df, "value", ["g"])._jdf.queryExecution().executedPlan().toString()
