"""Whole analyses: one read of the input, groups set aside, corrupt lines, and results that tasks write."""

import collections
import glob
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindlestat.operators import quality
from spindlestat.operators.errors import AnalysisError
from spindlestat.operators.roles import Roles
from spindlestat.plans import analysis
from spindlestat.sources import files

RNG = np.random.default_rng(21)


def counted(spark, df):
    """The same rows, and an accumulator of how often each has been made."""
    seen = spark.sparkContext.accumulator(0)

    def run(parts):
        for p in parts:
            seen.add(len(p))
            yield p

    return df.mapInPandas(run, df.schema), seen


def measurements(spark, n=400):
    rows = [(i, "abcd"[i % 4], float(RNG.normal(10 + i % 4, 1)), f"p{i % 10}", f"o{i // 10 % 3}", i // 30, "unused" * 20) for i in range(n)]
    return spark.createDataFrame(rows, "_row long, g string, measurement double, part string, operator string, trial long, notes string").repartition(3)


@pytest.mark.parametrize("kind", ["chart", "msa", "capability"])
def test_the_input_is_read_once(spark, kind):
    df, seen = counted(spark, measurements(spark))
    if kind == "chart":
        found = analysis.chart_analysis(spark, df, group_cols=["g"])
    elif kind == "msa":
        found = analysis.msa_analysis(spark, df)
    else:
        found = analysis.capability_analysis(spark, df, 16.0, 4.0, group_cols=["g"])
    with found:
        out = found.as_dict()
        assert out["success"] and len(found.tables) >= 6
        assert seen.value <= 2 * 400  # once, and what the test for emptiness reads
    before = seen.value
    assert next(iter(found.tables.values())).count() > 0  # valid after close(), from the input again
    assert seen.value >= before


def test_bad_groups_are_set_aside(spark):
    rows = [(i, g, str(RNG.normal(10, 1))) for i, g in enumerate("ab" * 60)] + [(i, "bad", str(i) if i % 2 else "words") for i in range(200, 240)] + [(300, None, "1")]
    df = spark.createDataFrame(rows, "_row long, g string, x string")
    with pytest.raises(AnalysisError, match="errors"):
        analysis.capability_analysis(spark, df, 20.0, 0.0, roles=Roles(value="x"), group_cols=["g"])
    with analysis.capability_analysis(spark, df, 20.0, 0.0, roles=Roles(value="x"), group_cols=["g"], quarantine=True) as found:
        assert {r.g: r.n for r in found.tables["capability"].collect()} == {"a": 60, "b": 60}
        aside = found.tables["quarantine"].collect()
        assert len(aside) == 40 and {(r.g, tuple(r.codes)) for r in aside} == {("bad", ("non_numeric",))}
        assert ("bad", "ERROR") in {(r.g, r.severity) for r in found.tables["issues"].collect()}
    out = analysis.run_control_chart_analysis(spark, df, Roles(value="x"), group_cols=["g"], quarantine=True)
    assert {r["g"] for r in out["limits"]} == {"a", "b"} and out["totals"]["quarantine"] == 40
    with pytest.raises(AnalysisError):
        analysis.chart_analysis(spark, df.filter("g = 'bad'"), Roles(value="x"), group_cols=["g"], quarantine=True)


def test_routing_of_many_groups(spark, monkeypatch):
    from spindlestat.functions import joins

    monkeypatch.setattr(joins, "GATHERED", 2)
    df = spark.range(1000).select((F.col("id") % 50).alias("g"), "id")
    found = spark.createDataFrame([(g, s, c) for g in range(50) for s, c in ([("ERROR", "b"), ("ERROR", "a"), ("WARNING", "c")] if g % 3 == 0 else [("WARNING", "c")])], "g long, severity string, code string")
    good, aside = quality.route(df, found, ["g"])
    assert {r.g for r in good.select("g").distinct().collect()} == {g for g in range(50) if g % 3}
    assert aside.count() == 17 * 20 and aside.first().codes == ["a", "b"]


def test_corrupt_lines(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "1.csv").write_text("a,b,c\n1,2.5,x\n2,3.5\n3,oops,y\n4,4.5,z,more\n5,,w\n")
    (tmp_path / "x" / "2.csv").write_text("a,b,c\n6,7.5,\"quoted, text\"\n7\n")
    schema = "a long, b double, c string"
    rows, corrupt = files.split_csv(spark, str(tmp_path / "x"), spark.createDataFrame([], schema).schema)
    assert sorted((r.a, r.b, r.c) for r in rows.orderBy("_row").collect() if r.b) == [(1, 2.5, "x"), (6, 7.5, "quoted, text")] and rows.filter("b IS NULL").first().a == 5
    bad = corrupt.orderBy("file", "start", "row").collect()
    assert [(r.file.rsplit("/", 1)[1], r.record) for r in bad] == [("1.csv", "2,3.5"), ("1.csv", "3,oops,y"), ("1.csv", "4,4.5,z,more"), ("2.csv", "7")]
    assert rows.select("a").count() == 3 and corrupt.count() == 4  # whatever columns are asked for
    with pytest.raises(AnalysisError) as e:
        files.strict_csv(spark, str(tmp_path / "x"), spark.createDataFrame([], schema).schema)
    assert e.value.code == "corrupt_rows" and "oops" in str(e.value.as_dict())
    (tmp_path / "good.csv").write_text("a,b\n1,2\n")
    assert files.strict_csv(spark, str(tmp_path / "good.csv")).first().b == 2
    with pytest.raises(AnalysisError) as e:
        files.split_csv(spark, str(tmp_path / "none.csv"))
    assert e.value.code == "file_not_found"


def test_pages_of_many_groups(spark, tmp_path):
    """A page for each of 3,000 groups, and an index, by tasks; nothing comes to the driver."""
    df = spark.range(9000).select((F.col("id") % 3000).alias("g"), F.concat(F.lit("<"), "id", F.lit("&>")).alias("text"), (F.col("id") / 7).alias("x"))
    one = df.groupBy("g").agg(F.count("x").alias("n"))
    files.write_group_pages("A & B", {"rows": df, "count": one}, ["g"], str(tmp_path / "out"), 2)
    pages = {int(f.split("g=")[1].split("/")[0]): open(f).read() for f in glob.glob(f"{tmp_path}/out/pages/g=*/part-*")}
    assert len(pages) == 3000
    assert "<title>A &amp; B</title>" in pages[5] and "<td>&lt;5&amp;&gt;</td>" in pages[5] and "2 of 3 rows" in pages[5] and "<p>g: 5</p>" in pages[5] and pages[5].count("<tr>") == 1 + 2 + 1 + 1 and pages[5].endswith("</html>\n")
    index = [json.loads(line) for f in glob.glob(f"{tmp_path}/out/index/part-*") for line in open(f)]
    assert {r["g"]: r["length"] for r in index} == {g: len(p) - 1 for g, p in pages.items()}


def test_an_analysis_is_written_by_tasks(spark, tmp_path):
    with analysis.chart_analysis(spark, measurements(spark), group_cols=["g"]) as found:
        found.write(str(tmp_path / "out"), ["g"])
        want = found.tables["limits"].count()
    lines = [json.loads(line) for f in glob.glob(f"{tmp_path}/out/limits/part-*") for line in open(f)]
    assert len(lines) == want == 4 and {r["g"] for r in lines} == set("abcd")
    assert len(glob.glob(f"{tmp_path}/out/report/pages/g=*")) == 4


def test_distinct_share_without_counting_all_values(spark, monkeypatch):
    """By range, by sketch, and by exact count where that is undecided."""
    rows = {"narrow": np.arange(1000) % 90, "wide": np.arange(1000) * 7, "few": (np.arange(1000) % 60) * 10**6, "near": np.r_[np.arange(301) * 1000, np.zeros(699)], "below": np.r_[np.arange(299) * 1000, np.zeros(701)], "exactly": np.r_[np.arange(300) * 1000, np.zeros(700)]}
    df = spark.createDataFrame([(g, float(x)) for g, v in rows.items() for x in v], "g string, x double")
    exact = []
    whole = F.count_distinct
    monkeypatch.setattr(quality.F, "count_distinct", lambda c: exact.append(1) or whole(c))
    got = {r.g: r.data_type for r in quality.chart_choice(df, Roles(value="x"), ["g"]).collect()}
    assert got == {"narrow": "attribute", "wide": "continuous", "few": "attribute", "near": "continuous", "below": "attribute", "exactly": "attribute"} and exact
    exact.clear()
    clear = df.filter("g IN ('narrow', 'wide', 'few')")
    assert collections.Counter(r.data_type for r in quality.chart_choice(clear, Roles(value="x"), ["g"]).collect()) == {"attribute": 2, "continuous": 1} and not exact
    alone = quality.chart_choice(df.filter("g = 'wide'"), Roles(value="x")).collect()
    assert len(alone) == 1 and alone[0].chart == "I-MR" and not math.isnan(alone[0].subgroup_size)
