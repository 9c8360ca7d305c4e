"""Measurement-system analysis: Gage R&R, bias, linearity, stability. Values are doubles with nulls for what is missing."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as k, ordering
from ..functions.lineage import cut_lineage
from ..functions.ordering import longest, positions
from ..functions.special import kendall_s, with_t_p_value
from .charts import imr_points
from .common import grouped, ratio, with_limits
from .errors import AnalysisError
from .roles import Roles

STUDIES = ("gage_rr", "bias", "linearity", "stability")


def study_for(df: DataFrame, roles: Roles) -> str:
    """Part, operator and trial: Gage R&R; a reference without operator: linearity if it varies, else bias; a date without operator: stability; else Gage R&R."""
    if roles.part and roles.operator and roles.trial:
        return "gage_rr"
    if roles.reference and not roles.operator:
        low, high = df.agg(F.min(roles.reference), F.max(roles.reference)).first()
        return "linearity" if low != high else "bias"
    return "stability" if roles.date and not roles.operator else "gage_rr"


def _levels(df: DataFrame, value: str, part: str, operator: str, groups: Sequence[str]) -> DataFrame:
    """A row for each cell, each part and each operator (level 0, 1, 2) with n, m (its mean), total, and of cells r (the range of two or more values) and within."""
    x = F.col(value)
    cells = grouped(df, [*groups, part, operator]).agg(F.count(x).alias("n"), F.sum(x).alias("total"), (F.var_pop(x) * F.count(x)).alias("within"), F.when(F.count(x) > 1, F.max(x) - F.min(x)).alias("r"))
    sets = [[*groups, part, operator], [*groups, part], [*groups, operator]]
    level = F.when(F.grouping(part) == 1, 2).when(F.grouping(operator) == 1, 1).otherwise(0)
    out = cells.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in (*groups, part, operator)])
    return out.agg(level.alias("level"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("within").alias("within"), F.max("r").alias("r")).withColumn("m", ratio(F.col("total"), F.col("n")))


def gage_rr(df: DataFrame, value: str, part: str, operator: str, groups: Sequence[str] = (), tolerance: float | None = None) -> DataFrame:
    """ANOVA of a crossed study: sums of squares, mean squares, variance components, study variation, percentages, NDC and verdicts.

    One pass sums up the cells, grouping sets over the cells sum up parts and operators, and one aggregate takes the
    squares of all of these: three shuffles, no join. Squares about the grand mean are those about the mean of means,
    by central moments, and the square of the distance of both.
    """
    is_at = lambda k, c: F.when(F.col("level") == k, F.col(c))
    moments = {}
    for k, name in enumerate(("cell", "part", "operator")):
        moments |= {f"k_{name}": F.count(is_at(k, "m")), f"v_{name}": F.var_pop(is_at(k, "m")), f"a_{name}": F.avg(is_at(k, "m"))}
    sums = {"n_rows": F.sum(is_at(0, "n")), "parts": F.count_if(F.col("level") == 1), "operators": F.count_if(F.col("level") == 2), "total": F.sum(is_at(0, "total")), "within": F.sum(is_at(0, "within")), "_joint": F.covar_pop(is_at(0, "total"), is_at(0, "m"))}
    t = grouped(_levels(df, value, part, operator, groups), groups).agg(*[c.alias(n) for n, c in (sums | moments).items()])
    t = t.withColumn("grand", ratio(F.col("total"), F.col("n_rows")))
    off = lambda c: F.col(f"a_{c}") - F.col("grand")
    t = t.withColumns({f"d_{c}": F.col(f"k_{c}") * (F.col(f"v_{c}") + off(c) * off(c)) for c in ("cell", "part", "operator")})
    # the sum of n (m - grand)^2 over cells, which may be of unequal size
    t = t.withColumn("between", F.greatest(F.col("k_cell") * F.col("_joint") + F.col("total") * off("cell"), F.lit(0.0)))
    p, o = F.col("parts"), F.col("operators")
    t = t.withColumn("trials", F.floor(F.col("n_rows") / (p * o)))
    n = F.col("trials")
    t = t.withColumns({"ss_total": F.col("within") + F.col("between"), "ss_part": o * n * F.col("d_part"), "ss_operator": p * n * F.col("d_operator")})
    t = t.withColumn("ss_interaction", n * F.col("d_cell") - F.col("ss_part") - F.col("ss_operator"))
    t = t.withColumn("ss_equipment", F.col("ss_total") - F.col("ss_part") - F.col("ss_operator") - F.col("ss_interaction"))
    t = t.withColumns({"df_part": p - 1, "df_operator": o - 1, "df_interaction": (p - 1) * (o - 1), "df_equipment": p * o * (n - 1)})
    t = t.withColumns({f"ms_{c}": F.when(F.col(f"df_{c}") > 0, ratio(F.col(f"ss_{c}"), F.col(f"df_{c}"))).otherwise(0.0) for c in ("part", "operator", "interaction", "equipment")})
    m = lambda c: F.col(f"ms_{c}")
    above = lambda a, b, n: F.greatest(ratio(a - b, n, 0.0), F.lit(0.0))
    t = t.withColumns({"var_repeatability": m("equipment"), "var_operator": above(m("operator"), m("interaction"), p * n), "var_interaction": above(m("interaction"), m("equipment"), n), "var_part": above(m("part"), m("interaction"), o * n)})
    t = t.withColumn("var_reproducibility", F.col("var_operator") + F.col("var_interaction"))
    t = t.withColumn("var_grr", F.col("var_repeatability") + F.col("var_reproducibility")).withColumn("var_total", F.col("var_grr") + F.col("var_part"))
    out = {}
    for c in ("repeatability", "reproducibility", "grr", "part", "total"):
        v = F.col(f"var_{c}")
        out |= {f"sd_{c}": F.sqrt(v), f"study_{c}": 6 * F.sqrt(v), f"contribution_{c}": 100 * ratio(v, F.col("var_total"), 0.0), f"percent_{c}": 100 * ratio(F.sqrt(v), F.sqrt("var_total"), 0.0), f"tolerance_{c}": (600 * F.sqrt(v) / F.lit(float(tolerance))) if tolerance else F.lit(None).cast("double")}
    t = t.withColumns(out).withColumn("ndc", F.floor(F.sqrt(F.lit(2.0)) * ratio(F.col("sd_part"), F.col("sd_grr"), 0.0)).cast("long"))
    verdict = F.when(F.col("percent_grr") < 10, "Excellent").when(F.col("percent_grr") < 30, "Acceptable").otherwise("Unacceptable")
    return t.withColumns({"verdict": verdict, "ndc_verdict": F.when(F.col("ndc") >= 5, "Adequate").otherwise("Inadequate")}).drop("within", "between", "total", "grand", "_joint", *moments, "d_cell", "d_part", "d_operator")


def gage_rr_range(df: DataFrame, value: str, part: str, operator: str, groups: Sequence[str] = ()) -> DataFrame:
    """The range method: ev, av, pv, grr, tv and their percentages of tv."""
    is_at = lambda k, c: F.when(F.col("level") == k, F.col(c))
    spread = lambda k: F.max(is_at(k, "m")) - F.min(is_at(k, "m"))
    t = grouped(_levels(df, value, part, operator, groups), groups).agg(F.avg(is_at(0, "r")).alias("r_bar"), F.sum(is_at(0, "n")).alias("n_rows"), F.count_if(F.col("level") == 1).alias("parts"), F.count_if(F.col("level") == 2).alias("operators"), spread(2).alias("r_operator"), spread(1).alias("r_part"))
    t = t.withColumn("trials", F.floor(F.col("n_rows") / (F.col("parts") * F.col("operators"))))
    d2 = k.by_size(k.D2_GAGE, k.D2_GAGE_ELSE, F.col("trials"))
    t = t.withColumns({"ev": F.coalesce("r_bar", F.lit(0.0)) / d2, "pv": F.col("r_part") / d2, "a": F.col("r_operator") / d2})
    t = t.withColumn("av", F.sqrt(F.greatest(F.col("a") * F.col("a") - ratio(F.col("ev") * F.col("ev"), F.col("parts") * F.col("trials"), 0.0), F.lit(0.0)))).drop("a")
    t = t.withColumn("grr", F.sqrt(F.col("ev") * F.col("ev") + F.col("av") * F.col("av"))).withColumn("tv", F.sqrt(F.col("grr") * F.col("grr") + F.col("pv") * F.col("pv")))
    return t.withColumns({f"percent_{c}": 100 * ratio(F.col(c), F.col("tv"), 0.0) for c in ("ev", "av", "grr", "pv")})


def range_by_operator(df: DataFrame, value: str, part: str, operator: str, groups: Sequence[str] = ()) -> DataFrame:
    """The range of each part for each operator; 0 for a single trial."""
    return grouped(df, [*groups, operator, part]).agg((F.max(value) - F.min(value)).alias("range"))


def _t(out: DataFrame, t: Column, df: Column) -> DataFrame:
    out = out.withColumns({"t": t, "df": df})
    return with_t_p_value(out, "t", "df").withColumn("significant", F.coalesce(F.col("p_value") < 0.05, F.lit(False)))


def bias(df: DataFrame, value: str, reference: str, groups: Sequence[str] = (), p_values: bool = True) -> DataFrame:
    """n, bias, sd, percent_bias of the mean reference, t, df, p_value, significant."""
    b = F.col(value) - F.col(reference)
    out = grouped(df, groups).agg(F.count(b).alias("n"), F.avg(b).alias("bias"), F.stddev_samp(b).alias("sd"), F.avg(reference).alias("mean_reference"))
    out = out.withColumn("percent_bias", 100 * ratio(F.abs("bias"), F.abs("mean_reference"), 0.0))
    t, df_ = ratio(F.col("bias"), F.col("sd") / F.sqrt("n")), F.col("n") - 1
    return _t(out, t, df_) if p_values else out.withColumns({"t": t, "df": df_})


def linearity(df: DataFrame, value: str, reference: str, groups: Sequence[str] = (), p_values: bool = True) -> DataFrame:
    """Regression of the bias on the reference. Both verdicts: small_slope (below 0.1) and, with p-values, significant."""
    b, x = F.col(value) - F.col(reference), F.col(reference)
    out = grouped(df, groups).agg(F.regr_count(b, x).alias("n"), F.regr_slope(b, x).alias("slope"), F.regr_intercept(b, x).alias("intercept"), F.regr_r2(b, x).alias("r2"), F.regr_sxx(b, x).alias("sxx"), F.regr_syy(b, x).alias("syy"))
    n = F.col("n")
    se = F.when(n > 2, F.sqrt(ratio((1 - F.col("r2")) * F.col("syy"), F.col("sxx") * F.when(n > 2, n - 2))))
    out = out.withColumn("std_error", se).withColumn("small_slope", F.abs("slope") < 0.1).drop("sxx", "syy")
    t, df_ = ratio(F.col("slope"), F.col("std_error")), n - 2
    return _t(out, t, df_) if p_values else out.withColumns({"t": t, "df": df_})


def bias_by_reference(df: DataFrame, value: str, reference: str, groups: Sequence[str] = ()) -> DataFrame:
    return grouped(df, [*groups, reference]).agg(F.avg(F.col(value) - F.col(reference)).alias("bias"), F.count(value).alias("n"))


#: Blocks of a long series that the trend is counted in, at most; a task holds one of them.
MOST_BLOCKS = 1024


def _counted(rows: DataFrame, key: Sequence[str], count) -> DataFrame:
    """key, s: count(part) of the rows of each key, in a task of its own."""
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.groupBy(*key).applyInPandas(lambda part: part[list(key)].head(1).assign(s=count(part)), ", ".join(f"`{c}` {fields[c]}" for c in key) + ", s long")


def _place(bounds: Column, x: Column) -> Column:
    """Where x lies among sorted bounds: 2 k between the k-th and the next one, 2 k - 1 at the k-th. Looked up in two steps."""
    width = F.greatest(F.floor(F.sqrt(F.size(bounds))).cast("int"), F.lit(1))
    tops = F.filter(bounds, lambda b, i: i % width == 0)
    row = F.size(F.filter(tops, lambda b: b <= x))
    near = F.slice(bounds, F.greatest((row - 1) * width, F.lit(0)) + 1, width)
    below = F.when(row > 0, (row - 1) * width + F.size(F.filter(near, lambda b: b <= x))).otherwise(0)
    return 2 * below - F.when(F.array_contains(near, x), 1).otherwise(0)


def _long_trend(rows: DataFrame, value: str, order_cols: Sequence[str], groups: Sequence[str], n_blocks: int) -> DataFrame:
    """groups, s: the count over series that no task holds.

    Rows fall into blocks by position and into classes by value: what lies between two of about as many quantiles, or is
    equal to one. A pair of rows lies in one block (counted there), in one class but two blocks (counted in the class,
    less what its blocks have; a class of equal values counts nothing), or differs in both; the latter need only the
    numbers of rows of each block and class, a table of n_blocks * (2 n_blocks + 1) at most.
    """
    x = F.col(value)
    rows = positions(rows.select(*groups, *[c for c in order_cols if c not in groups and c != value], value), order_cols, groups)
    shares = [(i + 1) / n_blocks for i in range(n_blocks - 1)]
    bounds = grouped(rows, groups).agg(F.array_sort(F.array_distinct(F.percentile_approx(x, F.lit(shares), 10 * n_blocks))).alias("_bounds"), F.count(x).alias("_n"))
    rows = with_limits(rows, bounds, groups)
    rows = rows.select(*groups, "seq", value, F.floor((F.col("seq") - 1) * n_blocks / F.col("_n")).cast("int").alias("_block"), _place(F.col("_bounds"), x).cast("int").alias("_class"))
    rows = cut_lineage(rows)
    in_order = lambda part: part.sort_values("seq")[value].to_numpy()

    def across_blocks(part: pd.DataFrame) -> int:
        return kendall_s(in_order(part)) - sum(kendall_s(in_order(p)) for _, p in part.groupby("_block"))

    def in_table(part: pd.DataFrame) -> int:
        cells = np.zeros((part["_block"].max() + 1, part["_class"].max() + 2), np.int64)
        cells[part["_block"], part["_class"] + 1] = part["n"]
        before = np.cumsum(cells, axis=0) - cells
        less = np.cumsum(before, axis=1) - before
        greater = before.sum(axis=1, keepdims=True) - less - before
        return sum(int(a) * int(b) for a, b in zip(cells.ravel().tolist(), (less - greater).ravel().tolist(), strict=True) if a)

    key = list(groups) or ["_all"]
    rows = rows if groups else rows.withColumn("_all", F.lit(0))
    table = rows.groupBy(*key, "_block", "_class").agg(F.count(F.lit(1)).alias("n"))
    parts = [_counted(rows, [*key, "_block"], lambda part: kendall_s(in_order(part))), _counted(rows.filter(F.col("_class") % 2 == 0), [*key, "_class"], across_blocks), _counted(table, key, in_table)]
    sums = parts[0].select(*key, "s").union(parts[1].select(*key, "s")).union(parts[2].select(*key, "s"))
    return sums.groupBy(*key).agg(F.sum("s").alias("s")).select(*groups, "s")


def trend(df: DataFrame, value: str, order_cols: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """n, s (pairs that rise minus pairs that fall), has_trend (beyond n (n - 1) / 4), in n log n steps.

    Series of up to ordering.STRIDE rows are counted by one task each; longer ones in blocks of which a task holds one.
    """
    rows = df.filter(F.col(value).isNotNull())
    rows = rows.dropna(subset=list(groups)) if groups else rows
    n = longest(rows, groups)
    if n > ordering.STRIDE:
        s = _long_trend(rows, value, order_cols, groups, min(MOST_BLOCKS, -(-n // ordering.STRIDE)))
    else:
        key = list(groups) or ["_all"]
        keyed = (rows if groups else rows.withColumn("_all", F.lit(0))).select(*dict.fromkeys([*(groups or ["_all"]), *order_cols, value]))
        s = _counted(keyed, key, lambda part: kendall_s(part.sort_values(list(order_cols), kind="stable")[value].to_numpy())).select(*groups, "s")
    out = grouped(df, groups).agg(F.count(value).alias("n"))
    out = out.join(s, list(groups), "left") if groups else out.join(s, F.lit(True), "left")
    out = out.withColumn("s", F.coalesce("s", F.lit(0)))
    return out.withColumn("has_trend", F.abs("s") > F.col("n") * (F.col("n") - 1) / 4)


def stability(df: DataFrame, value: str, order_cols: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """An individuals chart over time with the trend count. Both verdicts: in_limits (points only) and stable (points and trend)."""
    points = imr_points(df, value, order_cols, groups)
    out = grouped(points, groups).agg(F.count(value).alias("n"), F.first("cl").alias("mean"), F.stddev_samp(value).alias("sd"), F.first("ucl").alias("ucl"), F.first("lcl").alias("lcl"), F.count("reason").alias("n_out"))
    t = trend(df, value, order_cols, groups).drop("n")
    out = out.join(t, list(groups)) if groups else out.crossJoin(F.broadcast(t))  # one row
    fine = F.col("n_out") == 0
    return out.withColumns({"in_limits": fine, "stable": fine & ~F.col("has_trend")})


def gage_components(result: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """What a chart of variance components shows: component, contribution and percent_study of gage_rr()'s result."""
    parts = [F.struct(F.lit(c).alias("component"), F.col(f"contribution_{c}").alias("contribution"), F.col(f"percent_{c}").alias("percent_study")) for c in ("grr", "repeatability", "reproducibility", "part")]
    return result.select(*groups, F.explode(F.array(*parts)).alias("c")).select(*groups, "c.*")


def means_by(df: DataFrame, value: str, keys: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """mean and n by part, by operator or by both: the frames of the plots by part, by operator and of interaction."""
    return grouped(df, [*groups, *keys]).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def bias_points(df: DataFrame, value: str, reference: str, groups: Sequence[str] = ()) -> DataFrame:
    """Each measurement with its bias, and the mean bias that the plots of bias and linearity draw as a line, with the fitted line's value."""
    b, x = F.col(value) - F.col(reference), F.col(reference)
    line = grouped(df, groups).agg(F.avg(b).alias("mean_bias"), F.regr_slope(b, x).alias("_slope"), F.regr_intercept(b, x).alias("_intercept"))
    out = with_limits(df.filter(b.isNotNull()), line, groups)
    return out.select(*groups, F.col(reference).alias("reference"), F.col(value).alias("value"), b.alias("bias"), "mean_bias", (F.col("_intercept") + F.col("_slope") * x).alias("line"))


def stability_points(df: DataFrame, value: str, order_cols: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """seq, value, cl, ucl, lcl and reason of each point of a stability plot."""
    return imr_points(df, value, order_cols, groups).select(*groups, "seq", F.col(value).alias("value"), "cl", "ucl", "lcl", "reason")


def msa(df: DataFrame, roles: Roles, study: str | None = None, method: str = "anova", tolerance: float | None = None, groups: Sequence[str] = ()) -> tuple[str, DataFrame]:
    """The study named, or the one that the roles call for, and its result."""
    roles.check(df.schema)
    study = study or study_for(df, roles)
    if study not in STUDIES:
        raise AnalysisError("unknown_study", f"no study {study}; there are {', '.join(STUDIES)}")
    need = {"gage_rr": ("part", "operator"), "bias": ("reference",), "linearity": ("reference",), "stability": ("date",)}[study]
    if lacking := [r for r in need if not getattr(roles, r)]:
        raise AnalysisError("missing_columns", f"a {study} study needs {', '.join(lacking)}")
    if study == "gage_rr":
        return study, gage_rr(df, roles.value, roles.part, roles.operator, groups, tolerance) if method == "anova" else gage_rr_range(df, roles.value, roles.part, roles.operator, groups)
    if study == "stability":
        return study, stability(df, roles.value, [roles.date], groups)
    return study, (bias if study == "bias" else linearity)(df, roles.value, roles.reference, groups)
