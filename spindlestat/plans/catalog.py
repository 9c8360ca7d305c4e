"""Queries over the driver's tables, one or more for each operator, with the same in SQL."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions import constants as k
from ..functions.special import KS_ONE_SIDED_DUCKDB, ks_sql, quantile_sql, shapiro_scores_sql, shapiro_steps, t_normal_sql, t_two_sided_sql, upper_tail_sql
from ..functions.lineage import checkpoint_folder
from ..functions.ordering import positions
from ..operators import capability as cap, charts, msa, quality, roles
from ..operators.roles import Roles
from ..sources.files import as_json, split_csv
from . import analysis

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TYPE = ["event_type"]
USL, LSL, TARGET = 45.0, 5.0, 25.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def tidy(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """The columns, doubles rounded: sums depend on the order of rows in the last places."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in columns])


def rounded(columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns.split())


# Control charts

IMR = f"""
ranged AS (SELECT event_type, event_id, value, row_number() OVER w AS seq, abs(value - lag(value) OVER w) AS mr FROM events WHERE event_type IS NOT NULL WINDOW w AS (PARTITION BY event_type ORDER BY event_id)),
limits AS (SELECT event_type, count(value) AS n, avg(value) AS x_bar, avg(mr) AS mr_bar FROM ranged GROUP BY event_type),
lines AS (SELECT *, x_bar + {k.INDIVIDUALS} * mr_bar AS ucl, x_bar AS cl, x_bar - {k.INDIVIDUALS} * mr_bar AS lcl, {k.MOVING_RANGE} * mr_bar AS mr_ucl, 0e0 AS mr_lcl FROM limits)
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "ts", "value")


@query(f"WITH {IMR} SELECT event_type, n, {rounded('x_bar mr_bar ucl lcl mr_ucl mr_lcl')} FROM lines")
def imr_limits(spark, sf_dir):
    rows = charts.moving_range(events(spark, sf_dir), "value", ["event_id"], TYPE)
    return tidy(charts.imr_limits(rows, "value", TYPE), ["event_type", "n", "x_bar", "mr_bar", "ucl", "lcl", "mr_ucl", "mr_lcl"])


@query(f"WITH {IMR} SELECT event_type, seq, value, {rounded('mr')}, CASE WHEN value > ucl THEN 'Above UCL' WHEN value < lcl THEN 'Below LCL' END AS reason, CASE WHEN mr > mr_ucl THEN 'Above UCL' END AS mr_reason FROM ranged JOIN lines USING (event_type) WHERE value > ucl OR value < lcl OR mr > mr_ucl")
def imr_violations(spark, sf_dir):
    out = charts.imr_points(events(spark, sf_dir), "value", ["event_id"], TYPE).filter("reason IS NOT NULL OR mr_reason IS NOT NULL")
    return tidy(out, ["event_type", "seq", "value", "mr", "reason", "mr_reason"])


@query(f"WITH {IMR} SELECT event_type, count(*) AS n_points, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(avg(value) + 3 * stddev_pop(value), 6) AS plot_ucl, count(*) FILTER (WHERE value > ucl OR value < lcl) AS n_out, CASE WHEN count(*) FILTER (WHERE value > ucl OR value < lcl) = 0 THEN 'IN CONTROL' ELSE 'OUT OF CONTROL' END AS status FROM ranged JOIN lines USING (event_type) GROUP BY event_type")
def imr_summary(spark, sf_dir):
    points = charts.imr_points(events(spark, sf_dir), "value", ["event_id"], TYPE)
    return tidy(charts.summary(points, "value", TYPE), ["event_type", "n_points", "mean", "sd", "plot_ucl", "n_out", "status"])


@query("WITH r AS (SELECT value, abs(value - lag(value) OVER (ORDER BY event_id)) AS mr FROM events) SELECT count(value) AS n, round(avg(value), 6) AS x_bar, round(avg(mr), 6) AS mr_bar FROM r")
def imr_one_series(spark, sf_dir):
    """All events as one series: no task sees them all."""
    rows = charts.moving_range(events(spark, sf_dir).select("event_id", "value"), "value", ["event_id"])
    return tidy(charts.imr_limits(rows, "value"), ["n", "x_bar", "mr_bar"])


ZONES = "sum(CASE WHEN z {test} THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY seq ROWS BETWEEN {back} PRECEDING AND CURRENT ROW) >= {least}"


def _zone(pairs, back, least):
    return "(" + " OR ".join(ZONES.format(test=t, back=back, least=least) for t in pairs) + ")"


@query(f"WITH {IMR}, z AS (SELECT event_type, seq, (value - cl) / ((ucl - cl) / 3) AS z FROM ranged JOIN lines USING (event_type)), r AS (SELECT event_type, {_zone(('> 2', '< -2'), 2, 2)} AS a, {_zone(('> 1', '< -1'), 4, 4)} AS b, {_zone(('> 0', '< 0'), 7, 8)} AS c FROM z) SELECT event_type, count(*) FILTER (WHERE a) AS n_2of3, count(*) FILTER (WHERE b) AS n_4of5, count(*) FILTER (WHERE c) AS n_8run FROM r GROUP BY event_type")
def run_rules(spark, sf_dir):
    out = charts.run_rules(charts.imr_points(events(spark, sf_dir), "value", ["event_id"], TYPE), "value", TYPE)
    return out.groupBy("event_type").agg(F.count_if("rule_2of3").alias("n_2of3"), F.count_if("rule_4of5").alias("n_4of5"), F.count_if("rule_8run").alias("n_8run"))


def fives(spark: SparkSession, sf_dir: str, size: int = 5) -> DataFrame:
    """Events in subgroups of `size`, by type and time; the last one of a type may be smaller."""
    rows = positions(events(spark, sf_dir).select("event_type", "event_id", "value"), ["event_id"], TYPE)
    return rows.select("event_type", "value", F.floor((F.col("seq") - 1) / size).alias("block"))


def fives_sql(size: int = 5) -> str:
    return f"""rows_ AS (SELECT event_type, value, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // {size} AS block FROM events WHERE event_type IS NOT NULL),
subs AS (SELECT event_type, block, avg(value) AS mean, max(value) - min(value) AS spread_r, stddev_samp(value) AS spread_s, count(*) AS size FROM rows_ GROUP BY ALL)"""


def _xbar_sql(kind: str, size: int) -> str:
    n = size
    if kind == "R":
        a, low, high = k.A2.get(n, k.A2_ELSE), k.D3.get(n, k.D3_ELSE), k.D4.get(n, k.D4_ELSE)
    else:
        a, low, high = k.s_factors(n)
    s = f"spread_{kind.lower()}"
    return f"{fives_sql(size)}, lines AS (SELECT event_type, count(*) AS n_subgroups, avg(mean) AS x_bar, avg({s}) AS spread_bar, avg(mean) + {a!r}::double * avg({s}) AS ucl, avg(mean) - {a!r}::double * avg({s}) AS lcl, {high!r}::double * avg({s}) AS spread_ucl, {low!r}::double * avg({s}) AS spread_lcl FROM subs GROUP BY event_type)"


def _xbar(spark, sf_dir, kind, size):
    return charts.xbar_points(fives(spark, sf_dir, size), "value", "block", TYPE, kind)


LINES = ["event_type", "n_subgroups", "x_bar", "spread_bar", "ucl", "lcl", "spread_ucl", "spread_lcl"]


@query(f"WITH {_xbar_sql('R', 5)} SELECT event_type, n_subgroups, {rounded(' '.join(LINES[2:]))} FROM lines")
def xbar_r_limits(spark, sf_dir):
    rows = fives(spark, sf_dir)
    return tidy(charts.xbar_limits(charts.subgroups(rows, "value", "block", TYPE), "block", TYPE), LINES)


@query(f"WITH {_xbar_sql('R', 5)} SELECT event_type, block, round(mean, 6) AS mean, CASE WHEN mean > ucl THEN 'Above UCL' WHEN mean < lcl THEN 'Below LCL' END AS reason, CASE WHEN spread_r > spread_ucl THEN 'Above UCL' WHEN spread_r < spread_lcl THEN 'Below LCL' END AS spread_reason FROM subs JOIN lines USING (event_type) WHERE mean > ucl OR mean < lcl OR spread_r > spread_ucl OR spread_r < spread_lcl")
def xbar_r_violations(spark, sf_dir):
    return tidy(_xbar(spark, sf_dir, "R", 5).filter("reason IS NOT NULL OR spread_reason IS NOT NULL"), ["event_type", "block", "mean", "reason", "spread_reason"])


@query(f"WITH {_xbar_sql('S', 12)} SELECT event_type, n_subgroups, {rounded(' '.join(LINES[2:]))} FROM lines")
def xbar_s_limits(spark, sf_dir):
    return tidy(charts.xbar_limits(charts.subgroups(fives(spark, sf_dir, 12), "value", "block", TYPE), "block", TYPE, "S"), LINES)


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("defectives"), F.count(F.lit(1)).alias("n"))


MONTHLY = "m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) FILTER (WHERE o_orderstatus = 'F') AS defectives, count(*) AS n FROM orders GROUP BY 1)"
OUT = "CASE WHEN plotted > ucl THEN 'Above UCL' WHEN plotted < lcl THEN 'Below LCL' END AS reason"


def attribute_sql(center: str, plotted: str, spread: str, source: str, key: str) -> str:
    return f"c AS (SELECT {center} FROM {source}), p AS (SELECT {key}, {plotted} AS plotted, center AS cl, center + 3 * sqrt({spread}) AS ucl, greatest(center - 3 * sqrt({spread}), 0) AS lcl FROM {source}, c) SELECT {key}, {rounded('plotted cl ucl lcl')}, {OUT} FROM p"


@query(f"WITH {MONTHLY}, {attribute_sql('sum(defectives)::double / sum(n) AS center', 'defectives::double / n', 'center * (1 - center) / n', 'm', 'month')}")
def p_chart(spark, sf_dir):
    return tidy(charts.p_points(monthly(spark, sf_dir), "defectives", "n"), ["month", "plotted", "cl", "ucl", "lcl", "reason"])


def hundreds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.floor(F.col("event_id") / 100).alias("block")).agg(F.count_if(F.col("event_type") == "error").alias("defectives"), F.count(F.lit(1)).alias("n"))


HUNDREDS = "m AS (SELECT event_id // 100 AS block, count(*) FILTER (WHERE event_type = 'error') AS defectives, count(*) AS n FROM events GROUP BY 1)"


@query(f"WITH {HUNDREDS}, {attribute_sql('avg(defectives) AS center, min_by(n, block) AS size', 'defectives::double', 'center * (1 - center / size)', 'm', 'block')}")
def np_chart(spark, sf_dir):
    return tidy(charts.np_points(hundreds(spark, sf_dir), "defectives", "n", ["block"]), ["block", "plotted", "cl", "ucl", "lcl", "reason"])


@query(f"WITH m AS (SELECT strftime(ts, '%Y-%m-%d %H') AS hour, count(*) FILTER (WHERE event_type = 'error') AS defects FROM events GROUP BY 1), {attribute_sql('avg(defects) AS center', 'defects::double', 'center', 'm', 'hour')}")
def c_chart(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour")).agg(F.count_if(F.col("event_type") == "error").alias("defects"))
    return tidy(charts.c_points(e, "defects"), ["hour", "plotted", "cl", "ucl", "lcl", "reason"])


@query(f"WITH m AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS defects, count(*) AS units FROM events GROUP BY 1), {attribute_sql('sum(defects)::double / sum(units) AS center', 'defects::double / units', 'center / units', 'm', 'user_id')}")
def u_chart(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("defects"), F.count(F.lit(1)).alias("units"))
    return tidy(charts.u_points(e, "defects", "units"), ["user_id", "plotted", "cl", "ucl", "lcl", "reason"])


# Checks and the choice of a chart

DIRTY = "SELECT event_type, CAST(value AS VARCHAR) AS v FROM events UNION ALL SELECT 'dirty', x FROM (VALUES ('999'), ('-1'), ('abc'), (NULL), ('5')) AS t(x) UNION ALL SELECT 'constant', '7' FROM range(30)"


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.createDataFrame([("dirty", x) for x in ("999", "-1", "abc", None, "5")] + [("constant", "7")] * 30, "event_type string, v string")
    return table(spark, sf_dir, "events").select("event_type", F.col("value").cast("string").alias("v")).union(more)


_FOUND = [("'WARNING'", "missing_values", "n_missing", "n_missing > 0"), ("'ERROR'", "non_numeric", "n_text", "n_text > 0"), ("'WARNING'", "error_codes", "n_codes", "n_codes > 0"), ("'WARNING'", "negative_values", "n_negative", "n_negative > 0"), ("'WARNING'", "small_sample", "n", "n < 25"), ("'WARNING'", "no_variation", "n", "least = most"), ("'WARNING'", "high_variation", "n", "mean <> 0 AND sd / abs(mean) > 1")]


@query(f"WITH d AS ({DIRTY}), x AS (SELECT event_type, v, try_cast(v AS DOUBLE) AS x FROM d), p AS (SELECT event_type, count(x) AS n, count(*) FILTER (WHERE v IS NULL) AS n_missing, count(*) FILTER (WHERE v IS NOT NULL AND x IS NULL) AS n_text, count(*) FILTER (WHERE x IN (999, 9999, -999, -9999)) AS n_codes, count(*) FILTER (WHERE x < 0) AS n_negative, min(x) AS least, max(x) AS most, avg(x) AS mean, stddev_samp(x) AS sd FROM x GROUP BY 1) " + " UNION ALL ".join(f"SELECT event_type, {s} AS severity, '{c}' AS code, {n} AS n FROM p WHERE {t}" for s, c, n, t in _FOUND))
def quality_issues(spark, sf_dir):
    return quality.issues(dirty(spark, sf_dir), "v", "chart", TYPE).select("event_type", "severity", "code", "n")


def _choice_sql(source: str, value: str, group: str) -> str:
    return f"WITH p AS (SELECT {group} AS g, count(*) AS n, count(DISTINCT x) AS d, bool_and(x IN (0, 1)) AS b, bool_and(x = floor(x)) AS w, min(x) AS least, max(x) AS most FROM (SELECT {group}, CAST({value} AS DOUBLE) AS x FROM {source}) GROUP BY 1), t AS (SELECT g, b, CASE WHEN b OR (w AND least >= 0 AND most < 50) THEN 'attribute' WHEN NOT w THEN 'continuous' WHEN d::double / n > 0.3 THEN 'continuous' ELSE 'attribute' END AS data_type FROM p) SELECT g AS {group}, data_type, CASE WHEN data_type = 'attribute' THEN CASE WHEN b THEN 'defectives' ELSE 'defects' END END AS attribute_type, CASE WHEN data_type = 'continuous' THEN 'I-MR' WHEN b THEN 'NP' ELSE 'C' END AS chart FROM t"


@query(_choice_sql("events", "value", "event_type"))
def chart_choice_continuous(spark, sf_dir):
    return quality.chart_choice(events(spark, sf_dir), Roles(value="value"), TYPE).select("event_type", "data_type", "attribute_type", "chart")


@query(_choice_sql("lineitem", "l_linenumber", "l_returnflag"))
def chart_choice_counts(spark, sf_dir):
    return quality.chart_choice(table(spark, sf_dir, "lineitem"), Roles(value="l_linenumber"), ["l_returnflag"]).select("l_returnflag", "data_type", "attribute_type", "chart")


PROFILE = f"WITH d AS ({DIRTY}), x AS (SELECT event_type, v, try_cast(v AS DOUBLE) AS x FROM d), p AS (SELECT event_type, count(x) AS n, count(*) FILTER (WHERE v IS NULL) AS n_missing, count(*) FILTER (WHERE v IS NOT NULL AND x IS NULL) AS n_text, count(*) FILTER (WHERE x IN (999, 9999, -999, -9999)) AS n_codes, count(*) FILTER (WHERE x < 0) AS n_negative, count(*) FILTER (WHERE x > {USL} OR x < {LSL}) AS n_outside, min(x) AS least, max(x) AS most FROM x GROUP BY 1) "
_CAPABILITY_FOUND = [*_FOUND[:4], ("'WARNING'", "small_sample", "n", "n < 30"), ("'ERROR'", "no_variation", "n", "least = most"), ("'WARNING'", "mostly_outside", "n_outside", "n > 0 AND n_outside::double / n > 0.5")]
_MSA_FOUND = [("'ERROR'", "missing_values", "n_missing", "n_missing > 0"), ("'ERROR'", "no_variation", "n", "least = most")]


@query(PROFILE + " UNION ALL ".join(f"SELECT event_type, {s} AS severity, '{c}' AS code, {n} AS n FROM p WHERE {t}" for s, c, n, t in _CAPABILITY_FOUND))
def capability_issues(spark, sf_dir):
    return quality.issues(dirty(spark, sf_dir), "v", "capability", TYPE, USL, LSL).select("event_type", "severity", "code", "n")


@query(PROFILE + " UNION ALL ".join(f"SELECT event_type, {s} AS severity, '{c}' AS code, {n} AS n FROM p WHERE {t}" for s, c, n, t in _MSA_FOUND))
def msa_issues(spark, sf_dir):
    return quality.issues(dirty(spark, sf_dir), "v", "msa", TYPE).select("event_type", "severity", "code", "n")


@query("SELECT 'ERROR' AS severity, 'missing_references' AS code, count(*) AS n FROM events WHERE event_id % 100 = 7")
def missing_references(spark, sf_dir):
    """Every hundredth reference is made null, so that there is something to find."""
    rows = events(spark, sf_dir).withColumn("reference", F.when(F.col("event_id") % 100 != 7, F.col("value")))
    return quality.missing_references(rows, "reference")


@query("SELECT event_id, value FROM events WHERE value > 250 ORDER BY event_id LIMIT 10")
def first_rows(spark, sf_dir):
    return quality.first_rows(events(spark, sf_dir).select("event_id", "value"), {"large": F.col("value") > 250}, ["event_id"]).select("event_id", "value")


@query(f"WITH {MONTHLY}, {HUNDREDS.replace('m AS', 'h AS')} SELECT 'month' AS rows, CASE WHEN min(n) <> max(n) THEN 'P' ELSE 'NP' END AS chart FROM m UNION ALL SELECT 'hundreds', CASE WHEN min(n) <> max(n) THEN 'U' ELSE 'C' END FROM h")
def chart_choice_sizes(spark, sf_dir):
    """Sample sizes that vary call for P, opportunities that do not for C."""
    a = quality.chart_choice(monthly(spark, sf_dir), Roles(value="defectives", sample_size="n")).select(F.lit("month").alias("rows"), "chart")
    return a.union(quality.chart_choice(hundreds(spark, sf_dir), Roles(value="defectives", opportunity="n")).select(F.lit("hundreds"), "chart"))


@query(f"WITH {fives_sql()} SELECT event_type, min_by(size, block) AS subgroup_size, min(size) <> max(size) AS variable_subgroups, 'Xbar-R' AS chart FROM subs GROUP BY 1")
def chart_choice_subgroups(spark, sf_dir):
    return quality.chart_choice(fives(spark, sf_dir), Roles(value="value", subgroup="block"), TYPE).select("event_type", "subgroup_size", "variable_subgroups", "chart")


#: What each analysis picks as its value column, by name, in each table; fixed values that detection must find.
PICKED = {
    "events": {"chart": "value", "msa": "value", "capability": "value", "msa_first": "event_id"},
    "lineitem": {"chart": "l_discount", "msa": "l_orderkey", "capability": "l_orderkey", "msa_first": "l_orderkey"},
    "orders": {"chart": "o_orderkey", "msa": "o_orderkey", "capability": "o_orderkey", "msa_first": "o_orderkey"},
    "part": {"chart": "p_partkey", "msa": "p_size", "capability": "p_partkey", "msa_first": "p_partkey"},
}


@query(" UNION ALL ".join(f"SELECT '{t}' AS source, '{a}' AS analysis, '{c}' AS chosen, count({c}) AS n, round(avg({c}), 6) AS mean FROM {t}" for t, picks in PICKED.items() for a, c in picks.items()))
def value_columns(spark, sf_dir):
    """The value column that each analysis picks in each table, and its mean."""
    parts = []
    for name in PICKED:
        df = table(spark, sf_dir, name)
        found = {"chart": roles.chart_value(df.schema), "msa": roles.msa_value(df.schema), "capability": roles.capability_value(df.schema), "msa_first": roles.msa_value(df.schema, parity=True)}
        sums = df.agg(*[F.struct(F.lit(a).alias("analysis"), F.lit(c).alias("chosen"), F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean")).alias(a) for a, c in found.items()])
        parts.append(sums.select(F.lit(name).alias("source"), F.explode(F.array(*found)).alias("x")).select("source", "x.*"))
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


#: Lines of lineitem as measurements, under names that say what plays which role in a study.
STUDY_COLUMNS = {
    "gage_rr": {"l_suppkey": "Part", "l_returnflag": "Appraiser", "l_linenumber": "repeat_no", "l_quantity": "Reading"},
    "bias": {"fixed": "master", "l_quantity": "Measure"},
    "linearity": {"l_linenumber": "Standard", "l_quantity": "measured_value"},
    "stability": {"month": "ship_date", "quantity": "result"},
}
BY_MONTH = "SELECT date_trunc('month', l_shipdate) AS month, avg(l_quantity) AS quantity FROM lineitem GROUP BY 1"


@query(f"""SELECT 'gage_rr' AS study, 'Part,Appraiser,repeat_no,,' AS roles, 'Reading' AS value, count(*) AS n, round(var_pop(l_quantity) * count(*), 2) AS statistic FROM lineitem
UNION ALL SELECT 'bias', ',,,master,', 'Measure', count(*), round(avg(l_quantity - 25), 2) FROM lineitem
UNION ALL SELECT 'linearity', ',,,Standard,', 'measured_value', count(*), round(regr_slope(l_quantity - l_linenumber, l_linenumber), 2) FROM lineitem
UNION ALL SELECT 'stability', ',,,,ship_date', 'result', count(*), round(avg(quantity), 2) FROM ({BY_MONTH})""")
def study_choice(spark, sf_dir):
    """Roles found by name, the study that they call for, and its result, for each of the four studies."""
    lines = table(spark, sf_dir, "lineitem").withColumn("fixed", F.lit(25.0))
    monthly_mean = lines.groupBy(F.date_trunc("month", "l_shipdate").alias("month")).agg(F.avg("l_quantity").alias("quantity"))
    shown = {"gage_rr": ("n_rows", "ss_total"), "bias": ("n", "bias"), "linearity": ("n", "slope"), "stability": ("n", "mean")}
    parts = []
    for wanted, names in STUDY_COLUMNS.items():
        df = (monthly_mean if wanted == "stability" else lines).select(*[F.col(c).alias(name) for c, name in names.items()])
        value = roles.msa_value(df.schema)
        found = roles.msa_roles(df.schema, Roles(value=value))
        if found.reference == value:
            found = replace(found, reference=None)
        study, result = msa.msa(df.withColumn(value, F.col(value).cast("double")), found)
        n, statistic = shown[study]
        parts.append(result.select(F.lit(study).alias("study"), F.lit(",".join(getattr(found, r) or "" for r in roles.MSA_ROLES)).alias("roles"), F.lit(value).alias("value"), F.col(n).cast("long").alias("n"), F.round(statistic, 2).alias("statistic")))
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("SELECT 'C' AS chart, count(*) AS n_points, round(avg(l_quantity), 6) AS cl, round(avg(l_quantity) + 3 * sqrt(avg(l_quantity)), 6) AS ucl, round(greatest(avg(l_quantity) - 3 * sqrt(avg(l_quantity)), 0), 6) AS lcl FROM lineitem")
def chart_override(spark, sf_dir):
    """A C chart of quantities, which would be given another chart by default."""
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", F.lit(0).alias("_row"))
    found = analysis.chart_analysis(spark, rows, Roles(value="l_quantity"), chart="C")
    return tidy(found.tables["limits"].join(F.broadcast(found.tables["summary"].select("n_points", "chart")), "chart"), ["chart", "n_points", "cl", "ucl", "lcl"])


@query(f"SELECT l_returnflag, round(({USL} - {LSL}) / (6 * sqrt(var_samp(l_quantity) + pow(avg(l_quantity) - 25, 2))), 6) AS cpm, round(avg(l_quantity) - 25, 6) AS target_offset FROM lineitem GROUP BY 1")
def capability_default_target(spark, sf_dir):
    """Without a target, the middle of the limits is it."""
    return tidy(cap.capability(table(spark, sf_dir, "lineitem"), "l_quantity", USL, LSL, groups=["l_returnflag"]), ["l_returnflag", "cpm", "target_offset"])


#: Orders as lines of CSV: every 97th has a field too many, every 89th one too few, every 83rd a word for a price.
ORDER_LINES = "CASE WHEN o_orderkey % 97 = 0 THEN {full} || ',more' WHEN o_orderkey % 89 = 0 THEN {two} WHEN o_orderkey % 83 = 0 THEN {two} || ',dear' ELSE {full} END"


@query(f"WITH l AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderkey % 97 = 0 OR o_orderkey % 89 = 0 OR o_orderkey % 83 = 0 AS corrupt, {ORDER_LINES.format(two='o_orderkey || $$,$$ || o_custkey', full='o_orderkey || $$,$$ || o_custkey || $$,1$$')} AS line FROM orders) SELECT 'rows' AS part, count(*) AS n, sum(o_orderkey)::bigint AS keys, NULL AS first_record FROM l WHERE NOT corrupt UNION ALL SELECT 'corrupt', count(*), sum(o_orderkey)::bigint, min(line) FROM l WHERE corrupt")
def csv_quarantine(spark, sf_dir):
    """Orders written as CSV, some lines of which are corrupt, and read back in two parts."""
    two, full = (f"concat_ws(',', {x})" for x in ("o_orderkey, o_custkey", "o_orderkey, o_custkey, 1"))
    path = f"{checkpoint_folder(spark)}/csv-{uuid.uuid4().hex}"
    table(spark, sf_dir, "orders").select(F.expr(ORDER_LINES.format(two=two, full=full)).alias("line")).write.text(path)
    rows, corrupt = split_csv(spark, path, StructType().add("key", "long").add("customer", "long").add("price", "double"), header=False)
    good = rows.agg(F.lit("rows").alias("part"), F.count("price").alias("n"), F.sum("key").alias("keys"), F.lit(None).cast("string").alias("first_record"))
    return good.union(corrupt.agg(F.lit("corrupt"), F.count(F.lit(1)), F.sum(F.split("record", ",")[0].cast("long")), F.min("record")))


MIXED = "SELECT l_returnflag AS series, CAST(l_quantity AS VARCHAR) AS value FROM lineitem UNION ALL SELECT 'words', CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE CAST(c_custkey AS VARCHAR) END FROM customer UNION ALL SELECT 'still', '7' FROM nation"


@query(f"WITH m AS ({MIXED}), x AS (SELECT series, value, TRY_CAST(value AS DOUBLE) AS x FROM m), g AS (SELECT series, count(*) AS n, count(x) AS n_numbers, count(*) FILTER (x IS NULL) AS n_text, min(x) = max(x) AS still, avg(x) AS mean FROM x GROUP BY 1) SELECT series, 'analysed' AS part, n_numbers AS n, round(mean, 6) AS mean, '' AS codes FROM g WHERE n_text = 0 AND NOT still UNION ALL SELECT series, 'quarantine', n, NULL, CASE WHEN n_text > 0 AND still THEN 'no_variation,non_numeric' WHEN still THEN 'no_variation' ELSE 'non_numeric' END FROM g WHERE n_text > 0 OR still")
def quarantined_groups(spark, sf_dir):
    """Capability of the series whose data are sound; the rows of the others are set aside with their errors."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("series"), F.col("l_quantity").cast("string").alias("value"))
    words = table(spark, sf_dir, "customer").select(F.lit("words"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise(F.col("c_custkey").cast("string")))
    rows = lines.union(words).union(table(spark, sf_dir, "nation").select(F.lit("still"), F.lit("7")))
    found = analysis.capability_analysis(spark, rows.withColumn("_row", F.lit(0)), USL, LSL, TARGET, Roles(value="value"), ["series"], quarantine=True)
    good = found.tables["capability"].select("series", F.lit("analysed").alias("part"), "n", F.round("mean", 6).alias("mean"), F.lit("").alias("codes"))
    return good.union(found.tables["quarantine"].groupBy("series").agg(F.lit("quarantine"), F.count(F.lit(1)), F.lit(None).cast("double"), F.array_join(F.first("codes"), ",")))


@query("SELECT to_json({n_nationkey: n_nationkey, n_name: n_name})::VARCHAR AS json FROM nation")
def json_rows(spark, sf_dir):
    return as_json(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))


@query("WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), s AS (SELECT min(n) AS a, max(n) AS b, count(DISTINCT l_suppkey) AS p, count(DISTINCT l_returnflag) AS o FROM c) SELECT 'WARNING' AS severity, 'unbalanced' AS code, b AS n FROM s WHERE a <> b UNION ALL SELECT 'WARNING', 'few_parts', p FROM s WHERE p < 10 UNION ALL SELECT 'WARNING', 'few_operators', o FROM s WHERE o < 2")
def gage_design(spark, sf_dir):
    return quality.gage_issues(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_returnflag")


# Measurement systems

#: Suppliers are parts, return flags operators, and every line of a pair a trial.
GAGE = "g AS (SELECT l_suppkey AS user_id, l_returnflag AS event_type, l_quantity AS value FROM lineitem WHERE l_suppkey IS NOT NULL AND l_returnflag IS NOT NULL AND l_quantity IS NOT NULL)"
#: Users are parts, event types operators, and every event of a pair a trial.
EVERY = "g AS (SELECT user_id, event_type, value FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL)"


def gage_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_quantity").dropna()


ANOVA = f"""WITH {GAGE}, n AS (SELECT count(DISTINCT user_id)::double AS p, count(DISTINCT event_type)::double AS o, count(*) // (count(DISTINCT user_id) * count(DISTINCT event_type)) AS t, avg(value) AS m, var_pop(value) * count(*) AS ss_total FROM g),
a AS (SELECT sum((x - m) * (x - m)) AS d FROM (SELECT avg(value) AS x FROM g GROUP BY user_id), n), b AS (SELECT sum((x - m) * (x - m)) AS d FROM (SELECT avg(value) AS x FROM g GROUP BY event_type), n), c AS (SELECT sum((x - m) * (x - m)) AS d FROM (SELECT avg(value) AS x FROM g GROUP BY user_id, event_type), n),
ss AS (SELECT n.*, o * t * a.d AS ss_part, p * t * b.d AS ss_operator, t * c.d - o * t * a.d - p * t * b.d AS ss_interaction, ss_total - t * c.d AS ss_equipment FROM n, a, b, c),
ms AS (SELECT *, ss_part / (p - 1) AS mp, ss_operator / (o - 1) AS mo, ss_interaction / ((p - 1) * (o - 1)) AS mi, ss_equipment / (p * o * (t - 1)) AS me FROM ss),
v AS (SELECT *, me AS var_repeatability, greatest((mo - mi) / (p * t), 0) + greatest((mi - me) / t, 0) AS var_reproducibility, greatest((mp - mi) / (o * t), 0) AS var_part FROM ms),
w AS (SELECT *, var_repeatability + var_reproducibility AS var_grr, var_repeatability + var_reproducibility + var_part AS var_total FROM v),
z AS (SELECT *, 100 * sqrt(var_grr / var_total) AS percent_grr, 100 * var_grr / var_total AS contribution_grr, 600 * sqrt(var_grr) / 500 AS tolerance_grr, CASE WHEN var_grr = 0 THEN 0 ELSE floor(sqrt(2) * sqrt(var_part / var_grr)) END::bigint AS ndc FROM w)
SELECT {rounded('ss_total ss_part ss_operator ss_interaction ss_equipment var_repeatability var_reproducibility var_part var_total percent_grr contribution_grr tolerance_grr', 2)}, ndc, CASE WHEN percent_grr < 10 THEN 'Excellent' WHEN percent_grr < 30 THEN 'Acceptable' ELSE 'Unacceptable' END AS verdict FROM z"""


GAGE_COLUMNS = "ss_total ss_part ss_operator ss_interaction ss_equipment var_repeatability var_reproducibility var_part var_total percent_grr contribution_grr tolerance_grr ndc verdict".split()


@query(ANOVA)
def gage_rr_anova(spark, sf_dir):
    """Cells are of unequal size: the trials are their mean number, rounded down."""
    return tidy(msa.gage_rr(gage_data(spark, sf_dir), "l_quantity", "l_suppkey", "l_returnflag", tolerance=500.0), GAGE_COLUMNS, 2)


RANGE = f"""WITH {GAGE}, c AS (SELECT avg(r) AS r_bar FROM (SELECT max(value) - min(value) AS r FROM g GROUP BY user_id, event_type HAVING count(*) > 1)), o AS (SELECT max(m) - min(m) AS r FROM (SELECT avg(value) AS m FROM g GROUP BY event_type)), p AS (SELECT max(m) - min(m) AS r FROM (SELECT avg(value) AS m FROM g GROUP BY user_id)), s AS (SELECT count(DISTINCT user_id) AS parts, count(*) // (count(DISTINCT user_id) * count(DISTINCT event_type)) AS trials FROM g), n AS (SELECT parts * trials AS pt, {k.sql_by_size(k.D2_GAGE, k.D2_GAGE_ELSE, 'trials')}::double AS d2 FROM s),
x AS (SELECT r_bar / d2 AS ev, sqrt(greatest((o.r / d2) * (o.r / d2) - (r_bar / d2) * (r_bar / d2) / pt, 0)) AS av, p.r / d2 AS pv FROM c, o, p, n), y AS (SELECT *, sqrt(ev * ev + av * av) AS grr, sqrt(ev * ev + av * av + pv * pv) AS tv FROM x) SELECT {rounded('ev av pv grr tv')}, round(100 * grr / tv, 6) AS percent_grr FROM y"""
RANGE_COLUMNS = ["ev", "av", "pv", "grr", "tv", "percent_grr"]


@query(RANGE)
def gage_rr_range(spark, sf_dir):
    return tidy(msa.gage_rr_range(gage_data(spark, sf_dir), "l_quantity", "l_suppkey", "l_returnflag"), RANGE_COLUMNS)


@query("SELECT l_returnflag, l_suppkey, round(max(l_quantity) - min(l_quantity), 6) AS range FROM lineitem WHERE l_suppkey IS NOT NULL AND l_returnflag IS NOT NULL AND l_quantity IS NOT NULL GROUP BY ALL")
def range_by_operator(spark, sf_dir):
    return tidy(msa.range_by_operator(gage_data(spark, sf_dir), "l_quantity", "l_suppkey", "l_returnflag"), ["l_returnflag", "l_suppkey", "range"])


@query(ANOVA.replace(GAGE, EVERY))
def gage_rr_anova_whole(spark, sf_dir):
    return tidy(msa.gage_rr(events(spark, sf_dir), "value", "user_id", "event_type", tolerance=500.0), GAGE_COLUMNS, 2)


@query(RANGE.replace(GAGE, EVERY))
def gage_rr_range_whole(spark, sf_dir):
    return tidy(msa.gage_rr_range(events(spark, sf_dir), "value", "user_id", "event_type"), RANGE_COLUMNS)


@query(f"WITH {EVERY} SELECT event_type, user_id, round(max(value) - min(value), 6) AS range FROM g GROUP BY ALL")
def range_by_operator_whole(spark, sf_dir):
    return tidy(msa.range_by_operator(events(spark, sf_dir).filter("value IS NOT NULL"), "value", "user_id", "event_type"), ["event_type", "user_id", "range"])


PRICED = "r AS (SELECT l_returnflag, l_quantity, l_extendedprice AS x, l_quantity * p_retailprice AS ref FROM lineitem JOIN part ON l_partkey = p_partkey)"


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_quantity", "l_extendedprice")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return li.join(p, li.l_partkey == p.p_partkey).select("l_returnflag", "l_quantity", F.col("l_extendedprice").alias("x"), (F.col("l_quantity") * F.col("p_retailprice")).alias("ref"))


@query(f"WITH {PRICED}, b AS (SELECT l_returnflag, count(x - ref) AS n, avg(x - ref) AS bias, stddev_samp(x - ref) AS sd, avg(ref) AS mr FROM r GROUP BY 1) SELECT l_returnflag, n, round(bias, 4) AS bias, round(sd, 4) AS sd, round(100 * abs(bias) / abs(mr), 4) AS percent_bias, round(bias / (sd / sqrt(n)), 4) AS t FROM b")
def bias_study(spark, sf_dir):
    return tidy(msa.bias(priced(spark, sf_dir), "x", "ref", ["l_returnflag"], p_values=False), ["l_returnflag", "n", "bias", "sd", "percent_bias", "t"], 4)


@query(f"WITH {PRICED}, b AS (SELECT l_returnflag, regr_count(x - ref, ref) AS n, regr_slope(x - ref, ref) AS slope, regr_intercept(x - ref, ref) AS intercept, regr_r2(x - ref, ref) AS r2, regr_sxx(x - ref, ref) AS sxx, regr_syy(x - ref, ref) AS syy FROM r GROUP BY 1) SELECT l_returnflag, n::bigint AS n, round(slope, 4) AS slope, round(intercept, 4) AS intercept, round(r2, 4) AS r2, round(sqrt((1 - r2) * syy / sxx / (n - 2)), 4) AS std_error, abs(slope) < 0.1 AS small_slope FROM b")
def linearity_study(spark, sf_dir):
    return tidy(msa.linearity(priced(spark, sf_dir), "x", "ref", ["l_returnflag"], p_values=False), ["l_returnflag", "n", "slope", "intercept", "r2", "std_error", "small_slope"], 4)


def p_sql(base: str, keys: str) -> str:
    """Over base AS (keys, t, df): t, p_value and significant."""
    return f"""WITH {base}, z AS (SELECT *, {t_normal_sql('t', 'df')} AS z FROM base), p AS (SELECT *, {t_two_sided_sql('t', 'df', 'z')} AS p FROM z)
SELECT {keys}, round(t, 4) AS t, round(p, 6) AS p_value, p < 0.05 AS significant FROM p"""


def with_p(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys, F.round("t", 4).alias("t"), F.round("p_value", 6).alias("p_value"), "significant")


LINE = "SELECT l_returnflag, regr_count(x - ref, ref) AS n, regr_slope(x - ref, ref) AS slope, sqrt((1 - regr_r2(x - ref, ref)) * regr_syy(x - ref, ref) / regr_sxx(x - ref, ref) / (regr_count(x - ref, ref) - 2)) AS se FROM r GROUP BY 1"


@query(p_sql(f"{PRICED}, base AS (SELECT l_returnflag, 'bias' AS study, avg(x - ref) / (stddev_samp(x - ref) / sqrt(count(x - ref))) AS t, (count(x - ref) - 1)::double AS df FROM r GROUP BY 1 UNION ALL SELECT l_returnflag, 'linearity', slope / se, (n - 2)::double FROM ({LINE}))", "l_returnflag, study"))
def study_p_values(spark, sf_dir):
    rows = priced(spark, sf_dir)
    a = msa.bias(rows, "x", "ref", ["l_returnflag"]).select("l_returnflag", F.lit("bias").alias("study"), "t", "p_value", "significant")
    return with_p(a.union(msa.linearity(rows, "x", "ref", ["l_returnflag"]).select("l_returnflag", F.lit("linearity"), "t", "p_value", "significant")), ["l_returnflag", "study"])


@query(p_sql("base AS (SELECT l_partkey, avg(l_quantity - 25) / (stddev_samp(l_quantity - 25) / sqrt(count(l_quantity))) AS t, (count(l_quantity) - 1)::double AS df FROM lineitem GROUP BY 1)", "l_partkey"))
def bias_by_part(spark, sf_dir):
    """Whether the mean quantity of each part is 25: about 30 lines for each of many parts, so p-values are by finite sums and by expansion."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", F.lit(25.0).alias("ref"))
    return with_p(msa.bias(rows, "l_quantity", "ref", ["l_partkey"]), ["l_partkey"])


@query("SELECT l_linenumber::double AS l_linenumber, round(avg(l_quantity - l_linenumber), 6) AS bias, count(l_quantity) AS n FROM lineitem GROUP BY 1")
def bias_by_reference(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", F.col("l_linenumber").cast("double").alias("l_linenumber"))
    return tidy(msa.bias_by_reference(rows, "l_quantity", "l_linenumber"), ["l_linenumber", "bias", "n"])


PRICES = "m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, avg(o_totalprice) AS price FROM orders GROUP BY 1)"


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.avg("o_totalprice").alias("price"))


TREND = "s AS (SELECT sum(sign(b.price - a.price))::bigint AS s FROM m a JOIN m b ON a.month < b.month)"


@query(f"WITH {PRICES}, {TREND}, r AS (SELECT price, abs(price - lag(price) OVER (ORDER BY month)) AS mr FROM m), l AS (SELECT count(*) AS n, avg(price) AS mean, stddev_samp(price) AS sd, avg(price) + 2.66 * avg(mr) AS ucl, avg(price) - 2.66 * avg(mr) AS lcl FROM r), o AS (SELECT count(*) AS n_out FROM m, l WHERE price > ucl OR price < lcl) SELECT n, round(mean, 4) AS mean, round(sd, 4) AS sd, round(ucl, 4) AS ucl, round(lcl, 4) AS lcl, n_out, s, abs(s) > n * (n - 1) / 4 AS has_trend, n_out = 0 AS in_limits, n_out = 0 AND NOT abs(s) > n * (n - 1) / 4 AS stable FROM l, o, s")
def stability_study(spark, sf_dir):
    return tidy(msa.stability(prices(spark, sf_dir), "price", ["month"]), ["n", "mean", "sd", "ucl", "lcl", "n_out", "s", "has_trend", "in_limits", "stable"], 4)


@query(f"WITH {PRICES}, {TREND} SELECT s FROM s")
def trend_pairs(spark, sf_dir):
    """The SQL compares all pairs, the query counts them in n log n steps."""
    return msa.trend(prices(spark, sf_dir), "price", ["month"]).select("s")


# Capability

CAP = ["n", "mean", "sigma_overall", "sigma_within", "cp", "cpu", "cpl", "cpk", "cpm", "pp", "ppk", "ppm", "n_above", "n_below", "yield_percent", "dpmo", "z_bench", "expected_dpmo", "sigma_level", "offset", "offset_percent", "centered", "centered_by_gap", "tool_rating", "report_rating"]


def cap_sql(base: str, group: str) -> str:
    """Over base AS (group, n, mean, so, sw, n_above, n_below)."""
    index = lambda s, p: f"CASE WHEN {s} > 0 THEN ({USL} - {LSL}) / (6 * {s}) ELSE 0 END AS {p}, CASE WHEN {s} > 0 THEN ({USL} - mean) / (3 * {s}) ELSE 0 END AS {p}u, CASE WHEN {s} > 0 THEN (mean - {LSL}) / (3 * {s}) ELSE 0 END AS {p}l, CASE WHEN {s} > 0 THEN least({USL} - mean, mean - {LSL}) / (3 * {s}) ELSE 0 END AS {p}k, ({USL} - {LSL}) / (6 * sqrt({s} * {s} + (mean - {TARGET}) * (mean - {TARGET}))) AS {p}m"
    steps = " ".join(f"WHEN dpmo >= {a} THEN {b}" for a, b in cap.STEPS)
    rate = lambda names: f"CASE WHEN cpk >= 1.67 THEN '{names[0]}' WHEN cpk >= 1.33 THEN '{names[1]}' WHEN cpk >= 1.0 THEN '{names[2]}' ELSE '{names[3]}' END"
    return f"""{base}, i AS (SELECT *, {index('sw', 'cp')}, {index('so', 'pp')}, 100 * (1 - (n_above + n_below)::double / n) AS yield_percent, 1e6 * (n_above + n_below)::double / n AS dpmo, least(({USL} - mean) / so, (mean - {LSL}) / so) AS z_bench, mean - ({USL} + {LSL}) / 2 AS off FROM base)
SELECT {group}, n, {', '.join(f'round({a}, 6) AS {b}' for a, b in [('mean', 'mean'), ('so', 'sigma_overall'), ('sw', 'sigma_within'), *[(c, c) for c in 'cp cpu cpl cpk cpm pp ppk ppm'.split()]])}, n_above, n_below, {rounded('yield_percent dpmo z_bench')}, CASE WHEN z_bench > 0 THEN round(1e6 * {upper_tail_sql('z_bench')}, 6) END AS expected_dpmo, CASE WHEN dpmo = 0 THEN 6 {steps} ELSE 6 END AS sigma_level, round(off, 6) AS "offset", round(100 * abs(off) / (({USL} - {LSL}) / 2), 6) AS offset_percent, 100 * abs(off) / (({USL} - {LSL}) / 2) < 25 AS centered, abs(cp - cpk) < 0.1 AS centered_by_gap, {rate(('World-class', 'Excellent', 'Adequate', 'Unacceptable'))} AS tool_rating, {rate(('Excellent', 'Excellent', 'Adequate', 'Poor'))} AS report_rating FROM i"""


SIDES = f"count(*) FILTER (WHERE x > {USL}) AS n_above, count(*) FILTER (WHERE x < {LSL}) AS n_below"


@query("WITH " + cap_sql(f"base AS (SELECT l_returnflag, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS so, stddev_samp(x) AS sw, {SIDES} FROM (SELECT l_returnflag, l_quantity AS x FROM lineitem) GROUP BY 1)", "l_returnflag"))
def capability(spark, sf_dir):
    return tidy(cap.capability(table(spark, sf_dir, "lineitem"), "l_quantity", USL, LSL, TARGET, groups=["l_returnflag"]), ["l_returnflag", *CAP])


@query("WITH " + cap_sql(f"{fives_sql()}, w AS (SELECT event_type, avg(spread_r) / {k.sql_by_size(k.D2_WITHIN, k.D2_WITHIN_ELSE, 'floor(avg(size))')}::double AS sw FROM subs GROUP BY 1), base AS (SELECT event_type, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS so, any_value(sw) AS sw, {SIDES} FROM (SELECT event_type, block, value AS x FROM rows_) JOIN subs USING (event_type, block) JOIN w USING (event_type) GROUP BY 1)", "event_type"))
def capability_subgroups(spark, sf_dir):
    return tidy(cap.capability(fives(spark, sf_dir), "value", USL, LSL, TARGET, "block", TYPE), ["event_type", *CAP])


RATED = "CASE WHEN {c} >= 1.67 THEN 'Excellent' WHEN {c} >= 1.33 THEN 'Good' WHEN {c} >= 1.0 THEN 'Marginal' ELSE 'Poor' END"
ASSESSED = f"""b AS (SELECT l_returnflag, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS s, {SIDES} FROM (SELECT l_returnflag, l_quantity AS x FROM lineitem) GROUP BY 1),
i AS (SELECT *, least({USL} - mean, mean - {LSL}) / (3 * s) AS cpk, 100 * (1 - (n_above + n_below)::double / n) AS y, 100 * abs(mean - ({USL} + {LSL}) / 2) / (({USL} - {LSL}) / 2) < 25 AS centered FROM b)
SELECT l_returnflag, {RATED.format(c='cpk')} AS rating, {RATED.format(c='cpk')} AS long_term_rating, concat_ws(' | ', 'Short-term capability: ' || {RATED.format(c='cpk')}, 'Long-term performance: ' || {RATED.format(c='cpk')}, CASE WHEN y >= 99.73 THEN 'Yield: excellent' WHEN y >= 99 THEN 'Yield: good' ELSE 'Yield: needs improvement' END, CASE WHEN centered THEN 'Process is centered' ELSE 'Process is off center' END) AS assessment FROM i"""


@query(f"WITH {ASSESSED}")
def capability_assessment(spark, sf_dir):
    return cap.capability(table(spark, sf_dir, "lineitem"), "l_quantity", USL, LSL, groups=["l_returnflag"]).select("l_returnflag", "rating", "long_term_rating", "assessment")


@query(f"WITH b AS (SELECT event_type, avg(value) AS mean, stddev_samp(value) AS s, count(*) FILTER (WHERE value > {USL}) AS n_above FROM events GROUP BY 1) SELECT event_type, round(({USL} - mean) / (3 * s), 6) AS cpk, round(({USL} - mean) / s, 6) AS z_bench, n_above, 0::bigint AS n_below FROM b")
def capability_one_limit(spark, sf_dir):
    """Only an upper limit."""
    return tidy(cap.capability(events(spark, sf_dir), "value", USL, None, groups=TYPE), ["event_type", "cpk", "z_bench", "n_above", "n_below"])


@query("WITH m AS (SELECT event_type, avg(value) AS mean FROM events GROUP BY 1), d AS (SELECT event_type, value - mean AS d, mean FROM events JOIN m USING (event_type)) SELECT event_type, count(*) AS n, round(any_value(mean), 6) AS mean, round(sqrt(sum(d * d) / (count(*) - 1)), 6) AS sd, round(avg(d * d * d) / pow(avg(d * d), 1.5), 6) AS skew, round(avg(d * d * d * d) / (avg(d * d) * avg(d * d)) - 3, 6) AS kurt FROM d GROUP BY 1")
def moments(spark, sf_dir):
    return tidy(cap.moments(events(spark, sf_dir), "value", TYPE), ["event_type", "n", "mean", "sd", "skew", "kurt"])


SCORES = "m AS (SELECT event_type, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM events GROUP BY 1), z AS (SELECT event_type, value, n, mean, sd, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, (value - mean) / sd AS z FROM events JOIN m USING (event_type))"


@query(f"WITH {SCORES}, t AS (SELECT *, -z AS minus_z FROM z), u AS (SELECT *, {upper_tail_sql('z')} AS above, {upper_tail_sql('minus_z')} AS below FROM t) SELECT event_type, round(-any_value(n) - sum((2 * i - 1) * ln(below) + (2 * n + 1 - 2 * i) * ln(above)) / any_value(n), 4) AS a2, round(max(greatest(i::double / n - below, below - (i - 1)::double / n)), 6) AS ks_d FROM u GROUP BY 1")
def fit_statistics(spark, sf_dir):
    out = cap.fit_statistics(events(spark, sf_dir), "value", TYPE)
    return out.select("event_type", F.round("a2", 4).alias("a2"), F.round("ks_d", 6).alias("ks_d"))


@query(f"WITH {SCORES}, p AS (SELECT *, i::double / (n + 1) AS p FROM z) SELECT event_type, i, round({quantile_sql('p')}, 6) AS quantile, value, round(mean + sd * {quantile_sql('p')}, 6) AS line FROM p")
def qq_points(spark, sf_dir):
    return tidy(cap.qq(events(spark, sf_dir), "value", TYPE), ["event_type", "i", "quantile", "value", "line"])


@query(f"WITH {SCORES}, d AS (SELECT event_type, n, value - mean AS d, value, i, z FROM z), k AS (SELECT event_type, avg(d * d * d) / pow(avg(d * d), 1.5) AS skew, avg(d * d * d * d) / (avg(d * d) * avg(d * d)) - 3 AS kurt FROM d GROUP BY 1), t AS (SELECT event_type, n, i, z, -z AS minus_z FROM z), u AS (SELECT *, {upper_tail_sql('z')} AS above, {upper_tail_sql('minus_z')} AS below FROM t), a AS (SELECT event_type, any_value(n) AS n, -any_value(n) - sum((2 * i - 1) * ln(below) + (2 * n + 1 - 2 * i) * ln(above)) / any_value(n) AS a2 FROM u GROUP BY 1) SELECT event_type, round({cap.AD_CRITICAL} / (1 + 0.75 / n + 2.25 / (n::double * n)), 6) AS ad_critical, a2 < {cap.AD_CRITICAL} / (1 + 0.75 / n + 2.25 / (n::double * n)) AS ad_pass, abs(skew) < 1 AS skew_pass, abs(kurt) < 1 AS kurt_pass, CASE WHEN abs(skew) > 2 THEN 'Highly skewed: transform the data or use non-normal methods' WHEN abs(skew) > 1 THEN 'Moderately skewed: consider a transformation' ELSE 'No transformation is called for' END AS advice, CASE WHEN skew > 1 THEN 'log' WHEN skew < -1 THEN 'square' ELSE 'box-cox' END AS transformation FROM k JOIN a USING (event_type)")
def normality_votes(spark, sf_dir):
    """The votes and the advice that SQL can give too."""
    return tidy(cap.normality(events(spark, sf_dir), "value", TYPE), ["event_type", "ad_critical", "ad_pass", "skew_pass", "kurt_pass", "advice", "transformation"])


def normality_sql() -> str:
    """All five tests and their vote; Shapiro and Wilk's comes in steps."""
    steps = shapiro_steps()
    chain = ", ".join(f"s{k} AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in step.items())} FROM s{k - 1})" for k, step in enumerate(steps, 1))
    critical = f"({cap.AD_CRITICAL} / (1 + 0.75 / n + 2.25 / (n * n)))"
    return f"""WITH {SCORES}, d AS (SELECT event_type, value - mean AS d FROM z), k AS (SELECT event_type, avg(d * d * d) / pow(avg(d * d), 1.5) AS skew, avg(d * d * d * d) / (avg(d * d) * avg(d * d)) - 3 AS kurt FROM d GROUP BY 1),
t AS (SELECT *, -z AS minus_z, {shapiro_scores_sql('i', 'n')} AS m FROM z), u AS (SELECT *, {upper_tail_sql('z')} AS above, {upper_tail_sql('minus_z')} AS below FROM t),
s0 AS (SELECT event_type, any_value(n)::double AS n, any_value(mean) AS mean, any_value(sd) AS sd, -any_value(n) - sum((2 * i - 1) * ln(below) + (2 * n + 1 - 2 * i) * ln(above)) / any_value(n) AS a2, max(greatest(i::double / n - below, below - (i - 1)::double / n)) AS ks_d, sum(m * m) AS total, sum(m * value) AS inner_,
  max(value) FILTER (i = 1) AS x1, max(value) FILTER (i = 2) AS x2, max(value) FILTER (i = n - 1) AS xm, max(value) FILTER (i = n) AS xn, any_value(sd * sd * (n - 1)) AS ss FROM u GROUP BY 1),
{chain}, p AS (SELECT *, {ks_sql('ks_d', 'n', KS_ONE_SIDED_DUCKDB)} AS ks_p, {critical} AS ad_critical FROM s{len(steps)} JOIN k USING (event_type)),
v AS (SELECT *, a2 < ad_critical AS ad_pass, coalesce(sw_p > {cap.ALPHA}, false) AS sw_pass, ks_p > {cap.ALPHA} AS ks_pass, abs(skew) < 1 AS skew_pass, abs(kurt) < 1 AS kurt_pass FROM p), w AS (SELECT *, ad_pass::int + sw_pass::int + ks_pass::int + skew_pass::int + kurt_pass::int AS n_passed FROM v)
SELECT event_type, n::bigint AS n, {rounded('mean sd skew kurt a2', 4)}, {rounded('ks_d sw_w sw_p ks_p ad_critical')}, ad_pass, sw_pass, ks_pass, skew_pass, kurt_pass, n_passed, n_passed >= 3 AS is_normal, CASE WHEN n_passed >= 4 THEN 'High' WHEN n_passed >= 3 THEN 'Medium' ELSE 'Low' END AS confidence FROM w"""


NORMALITY = ["ks_d", "sw_w", "sw_p", "ks_p", "ad_critical", "ad_pass", "sw_pass", "ks_pass", "skew_pass", "kurt_pass", "n_passed", "is_normal", "confidence"]


def four(df: DataFrame, *columns: str) -> DataFrame:
    """These columns to four digits."""
    return df.withColumns({c: F.round(c, 4) for c in columns})


@query(normality_sql())
def normality(spark, sf_dir):
    """The vote of five tests."""
    out = cap.normality(events(spark, sf_dir), "value", TYPE)
    return tidy(four(out, "mean", "sd", "skew", "kurt", "a2"), ["event_type", "n", "mean", "sd", "skew", "kurt", "a2", *NORMALITY])


@query(normality_sql().replace("FROM events", "FROM (SELECT o_custkey AS event_type, o_totalprice AS value FROM orders)").replace(rounded("mean sd skew kurt a2", 4), rounded("skew kurt a2", 4)) + " WHERE n >= 3")
def normality_of_customers(spark, sf_dir):
    """The same for the orders of each customer: many groups of a few values."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("event_type"), F.col("o_totalprice").alias("value"))
    out = cap.normality(rows, "value", TYPE).filter("n >= 3")
    return tidy(four(out, "skew", "kurt", "a2"), ["event_type", "n", "skew", "kurt", "a2", *NORMALITY])


def power_sql() -> str:
    """y, y1, y2 as in Box and Cox's likelihood: power series where u is small."""
    series = lambda k: "(" + " + ".join(f"{math.perm(j, k)}e0 / {math.factorial(j + 1)}e0 * pow(u, {j - k})" for j in range(k, k + 12)) + ")"
    return f"t * CASE WHEN abs(u) < 0.3 THEN {series(0)} ELSE (exp(u) - 1) / u END AS y, t * t * CASE WHEN abs(u) < 0.3 THEN {series(1)} ELSE (u * exp(u) - exp(u) + 1) / (u * u) END AS y1, t * t * t * CASE WHEN abs(u) < 0.3 THEN {series(2)} ELSE (u * u * exp(u) - 2 * u * exp(u) + 2 * exp(u) - 2) / (u * u * u) END AS y2"


@query(f"""WITH RECURSIVE l AS (SELECT event_type, ln(value) - avg(ln(value)) OVER (PARTITION BY event_type) AS t FROM events WHERE event_type IN (SELECT event_type FROM events GROUP BY 1 HAVING min(value) > 0 AND max(value) > min(value))),
newton(k, event_type, lam) AS (SELECT 0, event_type, 0e0 FROM l GROUP BY 2 UNION ALL
  SELECT any_value(k) + 1, event_type, any_value(lam) + (covar_pop(y, y1) / var_pop(y)) / (-(var_pop(y1) + covar_pop(y, y2)) / var_pop(y) + 2 * pow(covar_pop(y, y1) / var_pop(y), 2))
  FROM (SELECT k, event_type, lam, {power_sql()} FROM (SELECT k, event_type, lam, t, lam * t AS u FROM newton JOIN l USING (event_type) WHERE k < 15)) GROUP BY event_type)
SELECT event_type, round(lam, 6) AS box_cox_lambda FROM newton WHERE k = 15""")
def box_cox(spark, sf_dir):
    return tidy(cap.box_cox(events(spark, sf_dir), "value", TYPE), ["event_type", "box_cox_lambda"])


@query("WITH e AS (SELECT event_type, min(value) AS a, max(value) AS b FROM events GROUP BY 1), h AS (SELECT event_type, a, b, least(floor((value - a) / ((b - a) / 30)), 29)::int AS bin FROM events JOIN e USING (event_type)) SELECT event_type, bin, round(any_value(a) + bin * (any_value(b) - any_value(a)) / 30, 6) AS low, round(any_value(a) + (bin + 1) * (any_value(b) - any_value(a)) / 30, 6) AS high, count(*) AS n FROM h GROUP BY event_type, bin")
def histogram(spark, sf_dir):
    return tidy(cap.histogram(events(spark, sf_dir), "value", TYPE), ["event_type", "bin", "low", "high", "n"])


@query("WITH t AS (SELECT event_type, min(value) AS a, max(value) AS b, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1), x AS (SELECT event_type, r.range::int AS i, a + r.range * (b - a) / 199 AS x, m, s FROM t, range(200) r) SELECT event_type, i, round(x, 6) AS x, round(exp(-(x - m) * (x - m) / (2 * s * s)) / (s * sqrt(2 * pi())), 6) AS density FROM x")
def normal_curve(spark, sf_dir):
    return tidy(cap.normal_curve(events(spark, sf_dir), "value", TYPE), ["event_type", "i", "x", "density"])


@query("SELECT event_type, min(value) AS least, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS most, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM events GROUP BY 1")
def box_plot(spark, sf_dir):
    return tidy(cap.box_plot(events(spark, sf_dir), "value", TYPE), ["event_type", "least", "q1", "median", "q3", "most", "mean", "sd"])


# Whole analyses

SERIES = "SELECT event_type AS series, event_id AS place, value FROM events UNION ALL SELECT 'lines', l_orderkey, l_linenumber::double FROM lineitem"


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of different kinds: measurements by event type, and small counts."""
    e = events(spark, sf_dir).select(F.col("event_type").alias("series"), F.col("event_id").alias("place"), "value")
    return e.union(table(spark, sf_dir, "lineitem").select(F.lit("lines"), "l_orderkey", F.col("l_linenumber").cast("double")))


@query(f"WITH s AS ({SERIES}), r AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY series ORDER BY place)) AS mr FROM s WHERE series <> 'lines'), l AS (SELECT series, 'I-MR' AS chart, avg(value) AS cl, {k.INDIVIDUALS} * avg(mr) AS half, false AS counts FROM r GROUP BY 1 UNION ALL SELECT series, 'C', avg(value), 3 * sqrt(avg(value)), true FROM s WHERE series = 'lines' GROUP BY 1) SELECT series, chart, round(cl, 6) AS cl, round(cl + half, 6) AS ucl, round(CASE WHEN counts THEN greatest(cl - half, 0) ELSE cl - half END, 6) AS lcl FROM l")
def analysis_chart_limits(spark, sf_dir):
    """Each series gets the chart that fits it."""
    found = analysis.chart_analysis(spark, series(spark, sf_dir), Roles(value="value", date="place"), group_cols=["series"])
    return tidy(found.tables["limits"], ["series", "chart", "cl", "ucl", "lcl"])


@query("WITH s AS (SELECT event_type AS series, event_id AS place, value FROM events UNION ALL SELECT 'refunds', o_orderkey, -o_totalprice FROM orders), t AS (SELECT series, 'error_codes' AS code, place, value FROM s WHERE value IN (999, 9999, -999, -9999) UNION ALL SELECT series, 'negative_values', place, value FROM s WHERE value < 0) SELECT series, code, row_number() OVER (PARTITION BY series, code ORDER BY place) AS row_number, value FROM t QUALIFY row_number <= 10")
def analysis_issue_rows(spark, sf_dir):
    """The first rows of each finding."""
    refunds = table(spark, sf_dir, "orders").select(F.lit("refunds"), "o_orderkey", -F.col("o_totalprice"))
    rows = events(spark, sf_dir).select(F.col("event_type").alias("series"), F.col("event_id").alias("_row"), "value").union(refunds)
    found = analysis.chart_analysis(spark, rows, Roles(value="value", date="_row"), group_cols=["series"])
    return found.tables["issue_rows"].select("series", "code", F.col("place").cast("long").alias("row_number"), "value")


@query(ANOVA)
def analysis_gage_rr(spark, sf_dir):
    found = analysis.msa_analysis(spark, gage_data(spark, sf_dir), Roles(value="l_quantity", part="l_suppkey", operator="l_returnflag"), "gage_rr", tolerance=500.0)
    return tidy(found.tables["result"], GAGE_COLUMNS, 2)


@query(f"WITH {PRICED} SELECT round(ref, 4) AS reference, round(x - ref, 4) AS bias, round(avg(x - ref) OVER (), 3) AS mean_bias FROM r")
def analysis_bias_points(spark, sf_dir):
    """What a plot of bias is made of: every measurement."""
    rows = priced(spark, sf_dir).select("x", "ref")
    found = analysis.msa_analysis(spark, rows, Roles(value="x", reference="ref"), "bias")
    return found.tables["points"].select(F.round("reference", 4).alias("reference"), F.round("bias", 4).alias("bias"), F.round("mean_bias", 3).alias("mean_bias"))


@query("WITH " + cap_sql(f"base AS (SELECT l_returnflag, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS so, stddev_samp(x) AS sw, {SIDES} FROM (SELECT l_returnflag, l_quantity AS x FROM lineitem) GROUP BY 1)", "l_returnflag"))
def analysis_capability(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity")
    found = analysis.capability_analysis(spark, rows, USL, LSL, TARGET, Roles(value="l_quantity"), ["l_returnflag"])
    return tidy(found.tables["capability"], ["l_returnflag", *CAP])
