"""Control charts: limits, points, points beyond the limits, summaries. All are lazy, and by group_cols.

Values are doubles with nulls for what is missing (see sources.files.measured). Rows with a null group are left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as k
from ..functions.ordering import over_strides, with_previous
from .common import beyond, clip, grouped, ratio, with_limits
from .errors import AnalysisError
from .roles import Roles

CHARTS = ("I-MR", "Xbar-R", "Xbar-S", "P", "NP", "C", "U")


def moving_range(df: DataFrame, value: str, order_cols: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """The rows with seq and mr, the distance to the row before; null where either value is."""
    return with_previous(df, value, order_cols, groups).withColumn("mr", F.abs(F.col(value) - F.col("previous"))).drop("previous")


def imr_limits(ranged: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """n, x_bar, mr_bar, ucl, cl, lcl, mr_ucl, mr_cl, mr_lcl from rows with mr."""
    out = grouped(ranged, groups).agg(F.count(value).alias("n"), F.avg(value).alias("x_bar"), F.avg("mr").alias("mr_bar"))
    x, r = F.col("x_bar"), F.col("mr_bar")
    return out.withColumns({"ucl": x + k.INDIVIDUALS * r, "cl": x, "lcl": x - k.INDIVIDUALS * r, "mr_ucl": k.MOVING_RANGE * r, "mr_cl": r, "mr_lcl": F.when(r.isNotNull(), 0.0)})


def imr_points(df: DataFrame, value: str, order_cols: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Every row of an I-MR chart with its limits; reason says why a point is out, mr_reason the same of its range."""
    rows = moving_range(df, value, order_cols, groups)
    out = with_limits(rows, imr_limits(rows, value, groups), groups)
    return out.withColumns({"reason": beyond(F.col(value), F.col("ucl"), F.col("lcl")), "mr_reason": beyond(F.col("mr"), F.col("mr_ucl"), F.col("mr_lcl"))})


def subgroups(df: DataFrame, value: str, subgroup: str, groups: Sequence[str] = ()) -> DataFrame:
    """mean, range, sd and n of each subgroup."""
    x = F.col(value)
    return grouped(df, [*groups, subgroup]).agg(F.avg(x).alias("mean"), (F.max(x) - F.min(x)).alias("range"), F.stddev_samp(x).alias("sd"), F.count(x).alias("n"), F.count(F.lit(1)).alias("size"))


def xbar_limits(subs: DataFrame, subgroup: str, groups: Sequence[str] = (), kind: str = "R", clip_lcl: bool = False) -> DataFrame:
    """Limits of an Xbar-R or Xbar-S chart from subgroups; the subgroup size is that of the first subgroup.

    clip_lcl: the lower limit of the means is at least 0, which suits counts but not signed measurements.
    """
    spread = "range" if kind == "R" else "sd"
    out = grouped(subs, groups).agg(F.count(F.lit(1)).alias("n_subgroups"), F.min_by("size", subgroup).alias("subgroup_size"), F.avg("mean").alias("x_bar"), F.avg(spread).alias("spread_bar"))
    n, x, r = F.col("subgroup_size"), F.col("x_bar"), F.col("spread_bar")
    if kind == "R":
        a, low, high = (k.by_size(t, o, n) for t, o in ((k.A2, k.A2_ELSE), (k.D3, k.D3_ELSE), (k.D4, k.D4_ELSE)))
    else:
        a, low, high = (k.s_factor(i, n) for i in range(3))
    lcl = x - a * r
    return out.withColumns({"ucl": x + a * r, "cl": x, "lcl": clip(lcl) if clip_lcl else lcl, "spread_ucl": high * r, "spread_cl": r, "spread_lcl": low * r})


def xbar_points(df: DataFrame, value: str, subgroup: str, groups: Sequence[str] = (), kind: str = "R", clip_lcl: bool = False) -> DataFrame:
    """Every subgroup with limits; reason is of its mean, spread_reason of its range or deviation."""
    subs = subgroups(df, value, subgroup, groups)
    out = with_limits(subs, xbar_limits(subs, subgroup, groups, kind, clip_lcl), groups)
    return out.withColumns({"reason": beyond(F.col("mean"), F.col("ucl"), F.col("lcl")), "spread_reason": beyond(F.col("range" if kind == "R" else "sd"), F.col("spread_ucl"), F.col("spread_lcl"))})


def _attribute_points(df: DataFrame, groups: Sequence[str], center: DataFrame, plotted: Column, spread: Column, center_of: Column) -> DataFrame:
    out = with_limits(df, center, groups).withColumns({"plotted": plotted, "cl": center_of})
    # a negative number under the root (a proportion above 1) has no limits
    s = 3 * F.sqrt(F.when(spread >= 0, spread))
    out = out.withColumns({"ucl": F.col("cl") + s, "lcl": clip(F.col("cl") - s)})
    return out.withColumn("reason", beyond(F.col("plotted"), F.col("ucl"), F.col("lcl")))


def p_points(df: DataFrame, value: str, size: str | None, groups: Sequence[str] = (), parity: bool = False) -> DataFrame:
    """Proportions with limits for each row's sample size (without one: the number of rows). parity: the raw count is compared."""
    n_rows = F.count(F.lit(1))
    center = grouped(df, groups).agg((F.sum(value).alias("s")), (F.sum(size) if size else n_rows * n_rows).cast("double").alias("t"), n_rows.alias("n_rows"))
    center = center.select(*groups, ratio(F.col("s"), F.col("t")).alias("p_bar"), "n_rows")
    n = F.col(size) if size else F.col("n_rows")
    p = F.col("p_bar")
    return _attribute_points(df, groups, center, F.col(value).cast("double") if parity else ratio(F.col(value), n), ratio(p * (1 - p), n), p)


def np_points(df: DataFrame, value: str, size: str | None, order_cols: Sequence[str] = (), groups: Sequence[str] = ()) -> DataFrame:
    """Counts of defectives for a constant sample size: the first one (without one: the number of rows)."""
    first = F.min_by(size, F.struct(*order_cols)) if size and order_cols else F.first(size, True) if size else F.count(F.lit(1))
    center = grouped(df, groups).agg(F.avg(value).alias("np_bar"), first.cast("double").alias("n_first"))
    c = F.col("np_bar")
    return _attribute_points(df, groups, center, F.col(value).cast("double"), c * (1 - ratio(c, F.col("n_first"))), c)


def c_points(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    center = grouped(df, groups).agg(F.avg(value).alias("c_bar"))
    return _attribute_points(df, groups, center, F.col(value).cast("double"), F.col("c_bar"), F.col("c_bar"))


def u_points(df: DataFrame, value: str, opportunity: str | None, groups: Sequence[str] = (), parity: bool = False) -> DataFrame:
    """Defects per unit with limits for each row's number of units (without one: 1). parity: the raw count is compared."""
    center = grouped(df, groups).agg(F.sum(value).alias("s"), (F.sum(opportunity) if opportunity else F.count(value)).cast("double").alias("t"))
    center = center.select(*groups, ratio(F.col("s"), F.col("t")).alias("u_bar"))
    units = F.col(opportunity) if opportunity else F.lit(1.0)
    return _attribute_points(df, groups, center, F.col(value).cast("double") if parity else ratio(F.col(value), units), ratio(F.col("u_bar"), units), F.col("u_bar"))


def summary(points: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """n, mean, sd, the widest plot limits (mean and 3 population sigmas), n_out and the status."""
    x, reason = F.col(value), F.col("reason")
    out = grouped(points, groups).agg(F.count(F.lit(1)).alias("n_points"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), (F.avg(x) + 3 * F.stddev_pop(x)).alias("plot_ucl"), (F.avg(x) - 3 * F.stddev_pop(x)).alias("plot_lcl"), F.count(reason).alias("n_out"))
    fine = F.col("n_out") == 0
    return out.withColumns({"status": F.when(fine, "IN CONTROL").otherwise("OUT OF CONTROL"), "recommendation": F.when(fine, "Process is stable; continue monitoring").otherwise("Investigate the special causes of the points beyond the limits")})


def run_rules(points: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Extension: Western Electric's zone rules on I-MR points (which have their position, seq), as columns rule_2of3, rule_4of5, rule_8run."""
    sigma = (F.col("ucl") - F.col("cl")) / 3
    z = (F.col(value) - F.col("cl")) / F.when(sigma != 0, sigma)
    seen = lambda w, test, n: F.sum(F.coalesce(test, F.lit(False)).cast("int")).over(w.rowsBetween(1 - n, 0))

    def rule(edge: int, least: int, n: int):
        return lambda w: (seen(w, F.col("_z") > edge, n) >= least) | (seen(w, F.col("_z") < -edge, n) >= least)

    rules = {"rule_2of3": rule(2, 2, 3), "rule_4of5": rule(1, 4, 5), "rule_8run": rule(0, 8, 8)}
    return over_strides(points.withColumn("_z", z), groups, 7, rules).drop("_z")


@dataclass
class ChartResult:
    chart: str
    points: DataFrame
    summary: DataFrame
    value: str

    @property
    def violations(self) -> DataFrame:
        return self.points.filter(F.col("reason").isNotNull())


def control_chart(df: DataFrame, roles: Roles, chart: str, order_cols: Sequence[str] = (), groups: Sequence[str] = (), **options) -> ChartResult:
    """The chart named. A date role is the order if no other is given."""
    if chart not in CHARTS:
        raise AnalysisError("unknown_chart", f"no chart {chart}; there are {', '.join(CHARTS)}")
    roles.check(df.schema)
    order = list(order_cols) or ([roles.date] if roles.date else [])
    value = roles.value
    if chart == "I-MR":
        if not order:
            raise AnalysisError("missing_columns", "an I-MR chart needs an order")
        points = imr_points(df, value, order, groups)
    elif chart in ("Xbar-R", "Xbar-S"):
        if not roles.subgroup:
            raise AnalysisError("missing_columns", f"an {chart} chart needs a subgroup")
        points, value = xbar_points(df, value, roles.subgroup, groups, chart[-1], **options), "mean"
    elif chart == "P":
        points = p_points(df, value, roles.sample_size, groups, **options)
    elif chart == "NP":
        points = np_points(df, value, roles.sample_size, order, groups)
    elif chart == "C":
        points = c_points(df, value, groups)
    else:
        points = u_points(df, value, roles.opportunity, groups, **options)
    return ChartResult(chart, points, summary(points, value, groups), value)
