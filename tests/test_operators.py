import json
import math

import exact
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from spindlestat.functions import constants, special
from spindlestat.functions import ordering
from spindlestat.operators import capability as cap, charts, msa, quality, roles
from spindlestat.operators.errors import AnalysisError
from spindlestat.plans import analysis
from spindlestat.sources import files

RNG = np.random.default_rng(5)


def series(spark, values, **columns):
    rows = [(i, None if v is None else float(v), *(c[i] for c in columns.values())) for i, v in enumerate(values)]
    kinds = [StructField("o", LongType()), StructField("value", DoubleType())] + [StructField(n, StringType() if isinstance(next((x for x in c if x is not None), 0), str) else DoubleType()) for n, c in columns.items()]
    return spark.createDataFrame([tuple(float(x) if isinstance(x, (int, np.number)) and k > 0 else x for k, x in enumerate(r)) for r in rows], StructType(kinds))


def test_imr_limits_and_points(spark):
    x = [10.0, 10.2, 9.9, 10.1, 14.0, 10.0, 9.8]
    got = charts.imr_points(series(spark, x), "value", ["o"]).orderBy("seq").collect()
    mr = np.abs(np.diff(x)).mean()
    assert math.isclose(got[0].ucl, np.mean(x) + 2.66 * mr) and got[0].mr is None
    assert [r.seq for r in got if r.reason or r.mr_reason] == [i + 1 for i in range(len(x)) if x[i] > np.mean(x) + 2.66 * mr or i and abs(x[i] - x[i - 1]) > 3.27 * mr]


def test_a_null_breaks_both_ranges(spark):
    got = charts.moving_range(series(spark, [1, None, 3, 4]), "value", ["o"]).orderBy("seq").collect()
    assert [r.mr for r in got] == [None, None, None, 1.0]


def test_series_without_groups_spans_strides(spark, monkeypatch):
    monkeypatch.setattr(ordering, "STRIDE", 7)
    x = RNG.permutation(100)
    df = series(spark, x).orderBy(F.rand(3)).repartition(5)
    got = ordering.with_previous(df, "value", ["o"]).orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(1, 101)) and [r.previous for r in got] == [None, *map(float, x[:-1])]


@pytest.mark.parametrize("parts", [1, 8])
def test_partitions_and_order_of_rows_do_not_matter(spark, parts):
    x = RNG.normal(size=40)
    df = series(spark, x, g=["a", "b"] * 20).orderBy(F.rand(1)).repartition(parts)
    got = {r.g: r.mr_bar for r in charts.imr_limits(charts.moving_range(df, "value", ["o"], ["g"]), "value", ["g"]).collect()}
    assert math.isclose(got["a"], np.abs(np.diff(x[::2])).mean()) and math.isclose(got["b"], np.abs(np.diff(x[1::2])).mean())


@pytest.mark.parametrize("size", [1, 2, 5, 9, 10])
def test_xbar_factors(spark, size):
    x = RNG.normal(10, 1, size=(8, size))
    df = series(spark, x.ravel(), s=np.repeat(np.arange(8), size).tolist())
    got = charts.xbar_limits(charts.subgroups(df, "value", "s"), "s").first()
    assert math.isclose(got.ucl, x.mean() + constants.A2.get(size, 0.31) * np.ptp(x, axis=1).mean())
    assert got.subgroup_size == size


def test_c4_and_s_factors():
    assert math.isclose(constants.c4(5), 0.9400, abs_tol=5e-5)
    assert np.allclose(constants.s_factors(5), (1.427, 0.0, 2.089), atol=6e-4)


def test_lcl_is_clipped_only_on_request(spark):
    df = series(spark, [-5, -7, -4, -6], s=[0, 0, 1, 1])
    subs = charts.subgroups(df, "value", "s")
    assert charts.xbar_limits(subs, "s").first().lcl < 0 and charts.xbar_limits(subs, "s", clip_lcl=True).first().lcl == 0


def test_attribute_charts(spark):
    df = series(spark, [3, 5, 2, 30], n=[100, 100, 50, 100])
    got = charts.p_points(df, "value", "n").orderBy("o").collect()
    p = 40 / 350
    assert math.isclose(got[0].ucl, p + 3 * math.sqrt(p * (1 - p) / 100)) and [r.reason for r in got] == [None, None, None, "Above UCL"]
    assert all(r.reason == "Above UCL" for r in charts.p_points(df, "value", "n", parity=True).collect())
    assert charts.p_points(series(spark, [100, 100]), "value", None).first().ucl is None  # a proportion above 1
    assert charts.c_points(df, "value").first().cl == 10
    u = charts.u_points(df, "value", "n").orderBy("o").first()
    assert math.isclose(u.ucl, p + 3 * math.sqrt(p / 100))
    assert math.isclose(charts.np_points(df, "value", "n", ["o"]).first().ucl, 10 + 3 * math.sqrt(10 * 0.9))


def test_unknown_chart_and_missing_roles_raise(spark):
    df = series(spark, [1, 2])
    for chart, code in (("X", "unknown_chart"), ("Xbar-R", "missing_columns"), ("I-MR", "missing_columns")):
        with pytest.raises(AnalysisError) as e:
            charts.control_chart(df, roles.Roles(value="value"), chart)
        assert e.value.code == code


def test_roles_by_name():
    schema = StructType([StructField(n, t) for n, t in (("Part", LongType()), ("Operator", StringType()), ("Trial", LongType()), ("Measurement", DoubleType()), ("width", DoubleType()))])
    assert roles.msa_value(schema) == "Measurement" and roles.msa_value(schema, parity=True) == "Part"
    found = roles.msa_roles(schema)
    assert (found.part, found.operator, found.trial, found.reference) == ("Part", "Operator", "Trial", None)
    only = StructType([StructField("width", DoubleType()), StructField("id", LongType())])
    assert roles.chart_value(only) == "width"  # both names hold `id`; the first stays
    with pytest.raises(AnalysisError):
        roles.chart_value(StructType([StructField("a", StringType())]))


def test_quality_of_edge_cases(spark):
    codes = lambda df, kind="chart": {r.code: r.n for r in quality.issues(df, "value", kind).collect()}
    assert codes(series(spark, [])) == {"small_sample": 0}
    assert codes(series(spark, [None, None, float("nan")]))["missing_values"] == 3
    assert codes(series(spark, [7.0] * 30)) == {"no_variation": 30}
    assert codes(series(spark, [-1, 999, 5]), "capability").keys() == {"negative_values", "error_codes", "small_sample"}
    texts = spark.createDataFrame([("1",), ("x",), (None,)], "value string")
    assert codes(texts)["non_numeric"] == 1
    with pytest.raises(AnalysisError):
        quality.gate(quality.issues(texts, "value"))


def test_chart_choice(spark):
    pick = lambda values, **c: quality.chart_choice(series(spark, values, **c), roles.Roles(value="value", **{k: k for k in c})).first()
    assert pick([0, 1, 1, 0])[:2] == ("attribute", "defectives") and pick([0, 1, 1, 0]).chart == "NP"
    assert pick([1, 2, 3]).chart == "C" and pick([1.5, 2.5]).chart == "I-MR"
    assert pick(list(range(100, 140))).data_type == "continuous" and pick([100, 200] * 20).data_type == "attribute"
    assert pick([1, 2, 3], sample_size=[10, 20, 30]).chart == "P" and pick([1, 2, 3], opportunity=[1, 2, 3]).chart == "U"
    assert pick(RNG.normal(size=20), subgroup=np.repeat(np.arange(2), 10).tolist()).chart == "Xbar-S"


def gage(spark, sigma=0.1):
    part, operator, trial = np.meshgrid(np.arange(10), np.arange(3), np.arange(2), indexing="ij")
    x = part + 0.2 * operator + RNG.normal(0, sigma, part.shape)
    return x, series(spark, x.ravel(), part=part.ravel().tolist(), operator=[f"o{o}" for o in operator.ravel()], trial=trial.ravel().tolist())


def test_gage_rr_sums_up_and_equals_numpy(spark):
    x, df = gage(spark)
    got = msa.gage_rr(df, "value", "part", "operator", tolerance=5).first()
    assert math.isclose(got.ss_total, got.ss_part + got.ss_operator + got.ss_interaction + got.ss_equipment)
    assert math.isclose(got.ss_part, 6 * ((x.mean(axis=(1, 2)) - x.mean()) ** 2).sum())
    assert math.isclose(got.ms_equipment, ((x - x.mean(axis=2, keepdims=True)) ** 2).sum() / 30)
    assert got.trials == 2 and got.verdict in ("Excellent", "Acceptable") and got.tolerance_grr > 0
    r = msa.gage_rr_range(df, "value", "part", "operator").first()
    assert math.isclose(r.ev, np.ptp(x, axis=2).mean() / 1.128)
    assert {i.code for i in quality.gage_issues(df.filter("o > 0"), "part", "operator").collect()} == {"unbalanced"}


def test_bias_and_linearity(spark):
    x, ref = RNG.normal(10.2, 0.1, 15), np.repeat([5.0, 10, 15], 5)
    got = msa.bias(series(spark, x, ref=[10.0] * 15), "value", "ref").first()
    t = (x - 10).mean() / ((x - 10).std(ddof=1) / math.sqrt(15))
    assert math.isclose(got.t, t) and got.significant and math.isclose(got.p_value, exact.t_two_sided(t, 14), rel_tol=1e-7)
    line = msa.linearity(series(spark, ref + 0.1 + 0.02 * ref + x / 1000, ref=ref.tolist()), "value", "ref").first()
    assert math.isclose(line.slope, 0.02, abs_tol=1e-3) and line.small_slope and line.significant


def test_trend_and_stability(spark):
    df = series(spark, list(range(20)), day=[f"2024-01-{i + 1:02d}" for i in range(20)])
    got = msa.stability(df, "value", ["day"]).first()
    assert got.s == 190 and got.has_trend and not got.stable
    assert msa.trend(df, "value", ["o"]).first().s == 190
    assert msa.study_for(df, roles.Roles(date="day")) == "stability"


def test_long_series_equal_short_ones(spark, monkeypatch):
    """The same rows with strides of 7 rows: positions, ranges, run rules and trends come out alike, with ties, nulls and groups of any size."""
    n = [100, 3, 41, 1]
    x = np.concatenate([RNG.integers(0, k // 3 + 1, k) for k in n]).astype(float)
    x[5] = np.nan
    df = series(spark, [None if np.isnan(v) else v for v in x], g=[f"g{i}" for i, k in enumerate(n) for _ in range(k)]).orderBy(F.rand(2)).repartition(5)

    def results(groups):
        points = charts.imr_points(df, "value", ["o"], groups)
        frames = charts.run_rules(points, "value", groups), msa.trend(df, "value", ["o"], groups), cap.fit_statistics(df, "value", groups).drop("values")
        return [sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in f.select(sorted(f.columns)).collect()), key=str) for f in frames]

    want = results(["g"]), results([])
    monkeypatch.setattr(ordering, "STRIDE", 7)
    assert (results(["g"]), results([])) == want
    pairs = {g: sum(np.sign(b - a) for i, a in enumerate(v) for b in v[i + 1 :]) for g, v in ((f"g{i}", p[~np.isnan(p)]) for i, p in enumerate(np.split(x, np.cumsum(n)[:-1])))}
    assert {r.g: r.s for r in msa.trend(df, "value", ["o"], ["g"]).collect()} == pairs


def test_kendall_equals_the_double_loop():
    for n in (0, 1, 2, 7, 64, 101):
        x = RNG.integers(0, 12, n).astype(float)
        assert special.kendall_s(x) == sum(np.sign(x[j] - x[i]) for i in range(n) for j in range(i + 1, n))


def test_capability_and_affine_invariance(spark):
    x = RNG.normal(10, 0.1, 60)
    a = cap.capability(series(spark, x), "value", 10.5, 9.5).first()
    b = cap.capability(series(spark, 3 * x + 7), "value", 38.5, 35.5).first()
    assert all(math.isclose(a[c], b[c], rel_tol=1e-9) for c in ("cp", "cpk", "cpm", "ppk", "z_bench"))
    assert math.isclose(a.cp, 1 / (6 * x.std(ddof=1)))
    flat = cap.capability(series(spark, [5.0] * 4), "value", 6, 4).first()
    assert flat.cp == 0 and flat.dpmo == 0 and flat.sigma_level == 6
    assert cap.capability(series(spark, [None]), "value", 6, 4).first().yield_percent is None
    zero = cap.capability(series(spark, [-1.0, 1.0, 0.5]), "value", 2, -2, target=0).first()
    assert zero.cpm is not None and zero.target_offset == zero.mean
    with pytest.raises(AnalysisError):
        cap.check_limits(1, 1)
    with pytest.raises(AnalysisError):
        cap.capability(series(spark, x), "value", None, None)
    up = cap.capability(series(spark, x), "value", 10.1, None).first()
    assert math.isclose(up.z_bench, (10.1 - x.mean()) / x.std(ddof=1)) and math.isclose(up.cpu, up.z_bench / 3) and up.cpk == up.cpu and up.cp is up.cpm is up.centered is None
    assert up.n_out == (x > 10.1).sum() and cap.capability(series(spark, x), "value", None, 9.9).first().n_below == (x < 9.9).sum()


def test_normality(spark):
    z = [exact.normal_quantile((i - 0.5) / 200) for i in range(1, 201)]
    assert cap.normality(series(spark, z), "value").first().is_normal is True
    skewed = cap.normality(series(spark, np.exp(2 * np.array(z))), "value").first()
    assert not skewed.is_normal and skewed.transformation == "log"
    few = cap.normality(series(spark, [1, 2]), "value").first()
    assert few.is_normal is None
    log = cap.box_cox(series(spark, np.exp(z)), "value").first()
    assert abs(log.box_cox_lambda) < 0.05


def test_box_cox_beyond_the_first_grid(spark):
    """Normal values to the power of 1 / lambda, against a fine search of the likelihood in plain numpy."""
    z = 10 + np.array([exact.normal_quantile((i - 0.5) / 200) for i in range(1, 201)])
    x = {lam: z ** (1 / lam) for lam in (-13, -0.5, 1, 7, 51)} | {"skewed": np.r_[np.ones(200), 0.01, 1.0001], "wide": 1e100 ** (z - 10), "big": 1e12 + 1e9 * z}
    df = series(spark, np.concatenate(list(x.values())), g=[str(k) for k, v in x.items() for _ in v])
    got = {r.g: r.box_cox_lambda for r in cap.box_cox(df, "value", ["g"]).collect()}

    def likelihood(v, lam):
        t = lam * (np.log(v) - np.log(v).mean())
        return -np.log(np.var(np.exp(t - t.max()))) / 2 - t.max() + np.log(abs(lam))

    assert got.keys() == {str(k) for k in x}
    for k, v in x.items():
        lam = got[str(k)]
        assert isinstance(k, str) or abs(lam - k) < 0.05 + 0.03 * abs(k)
        best = likelihood(v, lam if abs(lam) > 1e-9 else 1e-9) if k != "wide" else None
        assert k == "wide" and abs(lam) < 0.01 or best >= max(likelihood(v, g) for g in np.r_[-np.geomspace(0.01, 5000, 4000), np.geomspace(0.01, 5000, 4000)]) - 1e-6
    one = cap.box_cox(df.filter("g = '51'"), "value").first()
    assert math.isclose(one.box_cox_lambda, got["51"], rel_tol=1e-3)


def test_distribution_functions():
    assert math.isclose(exact.t_two_sided(2.228, 10), 0.05, abs_tol=1e-4)  # a printed table's value
    assert math.isclose(exact.ks_two_sided(0.274, 10), 1 - 0.6284796154565043)  # a published example
    assert exact.ks_two_sided(0.0, 10) == 1 and exact.ks_two_sided(1.0, 10) == 0
    assert math.isclose(exact.normal_quantile(0.975), 1.959963984540054)
    assert math.isnan(exact.shapiro_wilk(np.array([1.0, 1.0, 1.0]))[0])


def test_plot_frames(spark):
    df = series(spark, RNG.normal(size=50))
    assert sum(r.n for r in cap.histogram(df, "value").collect()) == 50
    assert cap.normal_curve(df, "value").count() == 200 and cap.qq(df, "value").count() == 50
    assert cap.histogram(series(spark, [2.0, 2.0]), "value").collect()[0].n == 2


def test_whole_analyses_from_files(spark, tmp_path):
    path = tmp_path / "x.csv"
    x = RNG.normal(10, 0.1, 40)
    path.write_text("sample,measurement\n" + "".join(f"{i},{v}\n" for i, v in enumerate(x)) + "\n")
    out = json.loads(analysis.attempt(analysis.run_control_chart_analysis, spark, str(path)))
    assert out["chart"] == "I-MR" and math.isclose(out["limits"][0]["cl"], x.mean())
    out = json.loads(analysis.attempt(analysis.run_capability_analysis, spark, str(path), 10.5, 9.5))
    assert math.isclose(out["capability"][0]["cp"], 1 / (6 * x.std(ddof=1)))
    assert json.loads(analysis.attempt(analysis.run_control_chart_analysis, spark, str(tmp_path / "none.csv")))["error"] == "file_not_found"
    (tmp_path / "empty.csv").write_text("a,b\n")
    assert json.loads(analysis.attempt(analysis.run_msa_analysis, spark, str(tmp_path / "empty.csv")))["error"] == "no_data"
    _, df = gage(spark)
    renamed = df.withColumnsRenamed({"value": "Measurement", "part": "Part", "operator": "Operator", "trial": "Trial"}).drop("o")
    assert analysis.run_msa_analysis(spark, renamed)["study"] == "gage_rr"


def test_report_and_json(spark):
    result = charts.control_chart(series(spark, RNG.normal(size=30)), roles.Roles(value="value"), "I-MR", ["o"])
    page = files.html_report("<x>", {"summary": result.summary})
    assert "&lt;x&gt;" in page and "IN CONTROL" in page or "OUT OF CONTROL" in page
    assert files.to_dict(series(spark, [float("nan")])) == [{"o": 0, "value": None}]
