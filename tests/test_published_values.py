"""Small samples with known results: what the analyses must give for them, from a CSV file to a report."""

import math

import pytest
from pyspark.sql import functions as F

from spindlestat.operators import capability as cap
from spindlestat.operators.errors import AnalysisError
from spindlestat.operators.roles import Roles
from spindlestat.plans import analysis
from spindlestat.sources import files

# The samples, and the results that are published for them.
IN_CONTROL = "100.12 99.85 100.23 99.92 100.15 99.88 100.05 100.18 99.95 100.08 100.22 99.78 100.12 100.05 99.92 100.18 99.85 100.15 100.02 99.95 100.08 100.12 99.88 100.05 99.98 100.15 100.22 99.85 100.08 99.95 100.12 100.05 99.92 100.18 99.88 100.15 100.02 99.95 100.08 100.12"
OUT_OF_CONTROL = "100.12 99.85 100.23 99.92 100.15 99.88 100.05 100.18 99.95 100.08 100.22 99.78 100.12 100.05 99.92 105.50 106.20 105.85 106.10 105.95 100.08 100.12 99.88 100.05 99.98 100.15 100.22 99.85 100.08 99.95"
CAPABLE = "10.05 10.08 10.02 10.06 10.04 10.07 10.03 10.05 10.06 10.04 10.08 10.02 10.05 10.07 10.03 10.06 10.04 10.05 10.07 10.03 10.05 10.06 10.04 10.08 10.02 10.05 10.07 10.03 10.06 10.04 10.05 10.07 10.03 10.05 10.06 10.04 10.08 10.02 10.05 10.07 10.03 10.06 10.04 10.05 10.07 10.03 10.05 10.06 10.04 10.05"
GAGE = "10.12 10.15 10.08 10.14 10.18 10.16 9.95 9.98 9.92 9.96 10.02 10.00 11.25 11.28 11.22 11.27 11.30 11.28 10.55 10.58 10.52 10.56 10.60 10.58 9.35 9.38 9.32 9.36 9.40 9.38 10.75 10.78 10.72 10.76 10.80 10.78 11.45 11.48 11.42 11.46 11.50 11.48 9.65 9.68 9.62 9.66 9.70 9.68 10.85 10.88 10.82 10.86 10.90 10.88 11.15 11.18 11.12 11.16 11.20 11.18"
STABLE = "10.12 10.15 10.08 10.14 10.18 10.16 10.11 10.19 10.13 10.17 10.15 10.12 10.20 10.14 10.18 10.16 10.11 10.22 10.13 10.17"
UNITS = "10 12 15 10 20 10 15 12 10 18 10 15 12 10 20 15 10 12 15 10"
DEFECTS = "5 8 12 6 15 7 10 9 5 14 8 11 7 4 16 12 6 8 10 5"


def near(a, b, digits=9):
    return math.isclose(a, b, rel_tol=10.0**-digits)


def csv(folder, name, header, *columns):
    path = folder / name
    path.write_text("\n".join([header, *map(",".join, zip(*columns, strict=True)), "", ""]))
    return str(path)


def test_individuals(spark, tmp_path):
    out = analysis.run_control_chart_analysis(spark, csv(tmp_path, "a.csv", "measurement", IN_CONTROL.split()))
    line = out["limits"][0]
    assert out["chart"] == "I-MR" and out["violations"] == [] and out["truncated"] == []
    assert near(line["ucl"], 100.54990256410258) and near(line["lcl"], 99.52409743589743) and near(line["cl"], 100.037) and near(line["mr_ucl"], 0.6305230769230873)
    out = analysis.run_control_chart_analysis(spark, csv(tmp_path, "b.csv", "measurement", OUT_OF_CONTROL.split()))
    assert near(out["limits"][0]["ucl"], 102.63242988505746) and sorted(v["seq"] for v in out["violations"]) == [16, 17, 18, 19, 20]
    assert out["totals"]["violations"] == 5 and out["summary"][0]["status"] == "OUT OF CONTROL"


def test_defects_per_unit_have_limits_for_each_number_of_units(spark, tmp_path):
    path = csv(tmp_path, "u.csv", "sample,units,defects", map(str, range(1, 21)), UNITS.split(), DEFECTS.split())
    out = analysis.run_control_chart_analysis(spark, path, Roles(value="defects", opportunity="units"))
    got = {r["size"]: (r["ucl"], r["lcl"]) for r in out["limits"]}
    want = {10: (1.465441827, 0), 12: (1.397180601, 0), 15: (1.321676167, 0.04230850722), 18: (1.265941109, 0.09804356494), 20: (1.235974784, 0.12800989)}
    assert out["chart"] == "U" and got.keys() == want.keys() and all(math.isclose(a, b, abs_tol=1e-8) for n in want for a, b in zip(got[n], want[n], strict=True))


def test_gage_and_stability(spark, tmp_path):
    x = GAGE.split()
    path = csv(tmp_path, "g.csv", "Part,Operator,Trial,Measurement", [str(i // 6 + 1) for i in range(60)], ["ABC"[i // 2 % 3] for i in range(60)], [str(i % 2 + 1) for i in range(60)], x)
    out = analysis.run_msa_analysis(spark, path)
    r = out["result"][0]
    assert out["study"] == "gage_rr" and near(r["ss_total"], 27.39769833, 7) and near(r["ss_part"], 27.35354833, 7) and near(r["ss_operator"], 0.02760333333, 7) and near(r["ss_interaction"], 0.0005966666667, 6) and near(r["ss_equipment"], 0.01595, 7)
    assert near(r["percent_grr"], 4.901922043, 7) and r["ndc"] == 28 and r["verdict"] == "Excellent" and r["ndc_verdict"] == "Adequate"
    assert out["totals"]["interaction"] == 30 and {c["component"] for c in out["components"]} == {"grr", "repeatability", "reproducibility", "part"}
    r = analysis.run_msa_analysis(spark, path, method="range")["result"][0]
    assert near(r["ev"], 0.0274822695, 7) and near(r["av"], 0.04613507885, 7) and near(r["percent_grr"], 2.883273247, 7)
    days = [f"2024-01-{d + 1:02d}" for d in range(20)]
    out = analysis.run_msa_analysis(spark, csv(tmp_path, "s.csv", "Date,Measurement", days, STABLE.split()))
    r = out["result"][0]
    assert out["study"] == "stability" and near(r["ucl"], 10.2891, 8) and r["s"] == 36 and r["stable"] and out["totals"]["points"] == 20


def test_capable_process(spark, tmp_path):
    path = csv(tmp_path, "c.csv", "measurement", CAPABLE.split())
    out = analysis.run_capability_analysis(spark, path, 10.5, 9.5)
    c, n = out["capability"][0], out["normality"][0]
    assert near(c["cp"], 9.722222222) and near(c["cpk"], 8.75) and near(c["cpm"], 3.153153153) and near(c["z_bench"], 26.25) and c["centered"] and near(c["offset_percent"], 10, 6)
    assert near(n["a2"], 0.8368131002, 6) and near(n["ks_d"], 0.12, 6) and near(n["sw_p"], 0.028747811832861007, 6) and near(n["kurt"], -0.8587962963, 7) and abs(n["skew"]) < 1e-9
    assert n["is_normal"] and n["confidence"] == "Medium" and n["n_passed"] == 3
    assert out["totals"] | {"issues": 0, "issue_rows": 0} == {"capability": 1, "normality": 1, "histogram": out["totals"]["histogram"], "normal_curve": 200, "box_plot": 1, "quantiles": 50, "issues": 0, "issue_rows": 0}
    page = analysis.capability_analysis(spark, path, 10.5, 9.5).report(str(tmp_path / "c.html"), most=5)
    assert "5 of 200 rows" in page and (tmp_path / "c.html").read_text() == page


def test_no_point_is_lost_without_a_word(spark):
    rows = spark.range(120_000).select(F.col("id").alias("place"), F.when(F.col("id") % 2 == 0, 1000.5).otherwise(-1000.5).alias("value"), F.lit("x").alias("kind"))
    # a moving range of 0 in all but one place: every point is out
    rows = rows.withColumn("value", F.when(F.col("place") < 60_000, 1000.5).otherwise(-1000.5))
    whole = analysis.chart_analysis(spark, rows, Roles(value="value", date="place"), chart="I-MR")
    assert whole.tables["violations"].count() == 120_000
    few = whole.as_dict(most=100)
    assert len(few["violations"]) == 100 and few["totals"]["violations"] == 120_000 and few["truncated"] == ["violations", "issue_rows"][:1]


def test_each_group_gets_its_own_chart(spark):
    rows = [("yes_no", i, float(i % 3 == 0)) for i in range(40)] + [("length", i, 10 + (i * 7 % 11) / 10) for i in range(40)] + [(None, 1, 1.0)]
    df = spark.createDataFrame(rows, "process string, place int, value double")
    out = analysis.run_control_chart_analysis(spark, df, Roles(value="value", date="place"), group_cols=["process"])
    assert {r["process"]: r["chart"] for r in out["limits"]} == {"yes_no": "NP", "length": "I-MR"} and out["chart"] is None and out["charts"] == ["I-MR", "NP"]
    assert {(r["process"], r["n_points"]) for r in out["summary"]} == {("yes_no", 40), ("length", 40)}
    with pytest.raises(TypeError):
        analysis.chart_analysis(spark, df, Roles(value="value", date="place"), nothing=1)


def test_findings_by_group_with_their_first_rows(spark):
    rows = [("a", i, "x" if i > 20 else str(float(i - 2))) for i in range(40)] + [("b", i, "999" if i in (3, 4) else "5") for i in range(40)]
    df = spark.createDataFrame(rows, "process string, place int, value string").withColumn("_row", F.col("place"))
    with pytest.raises(AnalysisError) as e:
        analysis.chart_analysis(spark, df, Roles(value="value", date="place"), group_cols=["process"])
    assert e.value.code == "data_quality_error" and e.value.details == ["non_numeric: 19"]
    out = analysis.run_control_chart_analysis(spark, df.filter("value <> 'x'"), Roles(value="value", date="place"), chart="I-MR", group_cols=["process"])
    assert {(r["process"], r["code"], r["_row"], r["place"]) for r in out["issue_rows"]} == {("a", "negative_values", 0, 1), ("a", "negative_values", 1, 2), ("b", "error_codes", 3, 1), ("b", "error_codes", 4, 2)}


def test_gage_design_by_group(spark):
    rows = [(g, p, o, t, float(p + o)) for g, trials in (("even", 2), ("uneven", 1)) for p in range(10) for o in range(3) for t in range(2 if g == "even" else 1 + (p == 0))]
    df = spark.createDataFrame(rows, "process string, part int, operator int, trial int, value double")
    out = analysis.run_msa_analysis(spark, df, Roles(value="value"), group_cols=["process"])
    assert [(i["process"], i["code"]) for i in out["issues"]] == [("uneven", "unbalanced")] and {r["process"] for r in out["result"]} == {"even", "uneven"}


def test_rows_of_files_keep_their_order(spark, tmp_path):
    """Several files of different sizes, cut into parts: `_row` follows path and place."""
    sizes = [50, 3000, 7, 900]
    for k, n in enumerate(sizes):
        (tmp_path / f"part{k}.csv").write_text("k,value\n" + "".join(f"{k * 10_000 + i},{i}.5\n" for i in range(n)))
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
        spark.conf.set("spark.sql.files.openCostInBytes", 16)
        df = files.read_csv(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 4
        got = [r.k for r in df.orderBy("_row").collect()]
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert got == [k * 10_000 + i for k, n in enumerate(sizes) for i in range(n)]


def test_sources_and_their_failures(spark, tmp_path):
    rows = files.from_rows(spark, [(1.5, "a"), (2.5, "b")], ["value", "name"])
    assert [(r.value, r["_row"]) for r in rows.orderBy("_row").collect()] == [(1.5, 0), (2.5, 1)]
    assert [r.value for r in files.from_rows(spark, [3.0, 4.0], ["value"]).orderBy("_row").collect()] == [3.0, 4.0]
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "head.csv").write_text("a,b\n")
    (tmp_path / "text.csv").write_text("a,b\nx,y\n")
    codes = []
    for call in (lambda: files.from_rows(spark, [], ["a"]), lambda: files.read_csv(spark, str(tmp_path / "none.csv")), lambda: files.read_csv(spark, str(tmp_path / "empty.csv")), lambda: files.read_csv(spark, str(tmp_path / "head.csv")), lambda: files.read_csv(spark, "nosuchscheme://x/y.csv"), lambda: analysis.chart_analysis(spark, str(tmp_path / "text.csv")), lambda: cap.check_limits(1, 2)):
        with pytest.raises(AnalysisError) as e:
            call()
        codes.append(e.value.code)
    assert codes == ["no_data", "file_not_found", "empty_file", "no_data", "read_error", "no_numeric_columns", "bad_limits"]
