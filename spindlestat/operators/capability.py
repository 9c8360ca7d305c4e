"""Process capability: indices, yield, centering, normality, ratings, and the frames that plots are made of.

Values are doubles with nulls for what is missing; rows with a null group are left out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as k
from ..functions.joins import settled
from ..functions.ordering import positions
from ..functions.selection import percentiles
from ..functions.special import SW_MOST, ks_sql, quantile_sql, shapiro_scores_sql, shapiro_steps, upper_tail
from .common import grouped, ratio, with_limits
from .errors import AnalysisError

# Fixed values.
AD_CRITICAL, ALPHA = 0.752, 0.05
CENTERED, CENTERED_GAP = 25.0, 0.1
STEPS = ((691462, 1), (308538, 2), (66807, 3), (6210, 4), (233, 5))


def check_limits(usl: float | None, lsl: float | None) -> None:
    if usl is None or lsl is None or not usl > lsl:
        raise AnalysisError("bad_limits", f"the upper limit must lie above the lower one: {usl}, {lsl}")


def within_sigma(df: DataFrame, value: str, subgroup: str, groups: Sequence[str] = ()) -> DataFrame:
    """sigma_within: the mean range of subgroups over d2 of their mean size. A subgroup of one has range 0."""
    subs = grouped(df, [*groups, subgroup]).agg((F.max(value) - F.min(value)).alias("r"), F.count(F.lit(1)).alias("size"))
    out = grouped(subs, groups).agg(F.avg("r").alias("r_bar"), F.floor(F.avg("size")).alias("size"))
    return out.select(*groups, (F.col("r_bar") / k.by_size(k.D2_WITHIN, k.D2_WITHIN_ELSE, F.col("size"))).alias("sigma_within"))


def indices(sigma: Column, mean: Column, usl: float | None, lsl: float | None, target: float | None, names: Sequence[str]) -> dict[str, Column]:
    """The five indices under the given names: width, upper, lower, the less of both, and about the target. 0 where sigma is 0; null for what a missing limit leaves open."""
    zero = lambda x: F.when(sigma > 0, x).when(sigma == 0, 0.0)
    s, none = F.when(sigma > 0, sigma), F.lit(None).cast("double")
    up = zero((usl - mean) / (3 * s)) if usl is not None else none
    low = zero((mean - lsl) / (3 * s)) if lsl is not None else none
    both = usl is not None and lsl is not None
    off = F.sqrt(sigma * sigma + (mean - target) * (mean - target)) if target is not None else none
    return dict(zip(names, (zero((usl - lsl) / (6 * s)) if both else none, up, low, F.least(up, low), ratio(F.lit(usl - lsl), 6 * off) if both else none), strict=True))


def capability(df: DataFrame, value: str, usl: float | None, lsl: float | None, target: float | None = None, subgroup: str | None = None, groups: Sequence[str] = ()) -> DataFrame:
    """Everything about capability but normality, a row for each group, from one aggregate (two with subgroups).

    Without a target, the middle of the limits is it. Without subgroups, the sigma within is the overall one, so cp and
    pp are equal. Counts, yield and dpmo are of the values that are there. One of the limits may be None: then the
    indices, the z bench and the counts are those of the other, and what needs both is null.
    """
    if usl is None and lsl is None:
        raise AnalysisError("bad_limits", "at least one limit is needed")
    both = usl is not None and lsl is not None
    if both:
        check_limits(usl, lsl)
        target = (usl + lsl) / 2 if target is None else target
    none = F.lit(None).cast("double")
    x = F.col(value)
    one = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    above, below = (x > usl if usl is not None else F.lit(False)), (x < lsl if lsl is not None else F.lit(False))
    t = grouped(df, groups).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sigma_overall"), one(above).alias("n_above"), one(below).alias("n_below"), F.min(x).alias("x_min"), F.max(x).alias("x_max"))
    if subgroup:
        s = within_sigma(df, value, subgroup, groups)
        t = t.join(s, list(groups)) if groups else t.crossJoin(F.broadcast(s))  # one row
    else:
        t = t.withColumn("sigma_within", F.col("sigma_overall"))
    mean = F.col("mean")
    t = t.withColumns(indices(F.col("sigma_within"), mean, usl, lsl, target, ("cp", "cpu", "cpl", "cpk", "cpm")) | indices(F.col("sigma_overall"), mean, usl, lsl, target, ("pp", "ppu", "ppl", "ppk", "ppm")))
    out = F.col("n_above") + F.col("n_below")
    t = t.withColumns({"n_out": out, "yield_percent": 100 * (1 - ratio(out, F.col("n"))), "dpmo": 1e6 * ratio(out, F.col("n"))})
    s = F.when(F.col("sigma_overall") > 0, F.col("sigma_overall"))
    t = t.withColumn("z_bench", F.least((usl - mean) / s if usl is not None else none, (mean - lsl) / s if lsl is not None else none))
    t = t.withColumn("expected_dpmo", F.when(F.col("z_bench") > 0, 1e6 * upper_tail("z_bench")))
    steps = F.when(F.col("dpmo") == 0, 6)
    for edge, level in STEPS:
        steps = steps.when(F.col("dpmo") >= edge, level)
    t = t.withColumns({"sigma_level": F.when(F.col("dpmo").isNotNull(), steps.otherwise(6)), "offset": mean - (usl + lsl) / 2 if both else none, "target_offset": mean - target if target is not None else none})
    t = t.withColumn("offset_percent", 100 * F.abs("offset") / ((usl - lsl) / 2) if both else none)
    t = t.withColumns({"centered": F.col("offset_percent") < CENTERED, "centered_by_gap": F.abs(F.col("cp") - F.col("cpk")) < CENTERED_GAP})
    rate = lambda c, names: F.when(c >= 1.67, names[0]).when(c >= 1.33, names[1]).when(c >= 1.0, names[2]).when(c.isNotNull(), names[3])
    t = t.withColumns({"rating": rate(F.col("cpk"), ("Excellent", "Good", "Marginal", "Poor")), "long_term_rating": rate(F.col("ppk"), ("Excellent", "Good", "Marginal", "Poor")), "tool_rating": rate(F.col("cpk"), ("World-class", "Excellent", "Adequate", "Unacceptable")), "report_rating": rate(F.col("cpk"), ("Excellent", "Excellent", "Adequate", "Poor"))})
    parts = (F.concat(F.lit("Short-term capability: "), "rating"), F.concat(F.lit("Long-term performance: "), "long_term_rating"), F.when(F.col("yield_percent") >= 99.73, "Yield: excellent").when(F.col("yield_percent") >= 99, "Yield: good").otherwise("Yield: needs improvement"), F.when(F.col("centered"), "Process is centered").when(~F.col("centered"), "Process is off center"))
    return t.withColumn("assessment", F.concat_ws(" | ", *parts))


def moments(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """n, mean, sd, skew and excess kurtosis (biased, as by moments)."""
    x = F.col(value)
    return grouped(df, groups).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"))


def normal_scores(df: DataFrame, value: str, groups: Sequence[str] = (), known: DataFrame | None = None) -> DataFrame:
    """Values that are there, with i (their rank), the moments of their group (known, unless they are to be computed), and z."""
    known = settled(moments(df, value, groups)) if known is None else known
    longest = known.agg(F.max("n")).first()[0] or 0
    ranked = positions(df.filter(F.col(value).isNotNull()), [value], groups, "i", longest)
    return with_limits(ranked, known, groups).withColumn("z", (F.col(value) - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd")))


def fit_statistics(df: DataFrame, value: str, groups: Sequence[str] = (), known: DataFrame | None = None) -> DataFrame:
    """Anderson-Darling's a2 and Kolmogorov-Smirnov's d against the fitted normal distribution, and sw_w and sw_p of Shapiro and Wilk for 3 to 5000 values (else null). Both tails are computed as such, so that far values count."""
    rows = normal_scores(df, value, groups, known).withColumn("minus_z", -F.col("z"))
    rows = rows.withColumns({"above": upper_tail("z"), "below": upper_tail("minus_z"), "score": F.when(F.col("n").between(3, SW_MOST), F.expr(shapiro_scores_sql("i", "n")))})
    i, n, x, m = F.col("i"), F.col("n"), F.col(value), F.col("score")
    term = (2 * i - 1) * F.ln("below") + (2 * n + 1 - 2 * i) * F.ln("above")
    gap = F.greatest(i / n - F.col("below"), F.col("below") - (i - 1) / n)
    at = lambda where: F.max(F.when(where, x))
    of_shapiro = {"total": F.sum(m * m), "inner_": F.sum(m * x), "x1": at(i == 1), "x2": at(i == 2), "xm": at(i == n - 1), "xn": at(i == n), "ss": F.first(F.col("sd") * F.col("sd") * (n - 1))}
    out = grouped(rows, groups).agg((-F.first("n") - F.sum(term) / F.first("n")).alias("a2"), F.max(F.when(F.col("z").isNotNull(), gap)).alias("ks_d"), F.first("n").cast("double").alias("n"), *[c.alias(name) for name, c in of_shapiro.items()])
    for step in shapiro_steps():
        out = out.withColumns({name: F.expr(sql) for name, sql in step.items()})
    return out.select(*groups, "a2", "ks_d", "sw_w", "sw_p")


def shapiro(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """sw_w, sw_p of each group of 3 to 5000 values; null for others."""
    return fit_statistics(df, value, groups).select(*groups, "sw_w", "sw_p")


def normality(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Five tests and their vote: normal if three or more pass. Fewer than 3 values: no verdict (null). With advice on transformations."""
    t = settled(moments(df, value, groups))
    fit = fit_statistics(df, value, groups, t).withColumnsRenamed({g: f"_of_{g}" for g in groups})
    same = [t[g] == fit[f"_of_{g}"] for g in groups]
    t = t.join(fit, same or F.lit(True), "left").drop(*[f"_of_{g}" for g in groups])  # a row for each group on either side
    t = t.withColumn("_n", F.col("n").cast("double")).withColumn("ks_p", F.expr(ks_sql("ks_d", "_n"))).drop("_n")
    n = F.col("n")
    critical = F.lit(AD_CRITICAL) / (1 + 0.75 / n + 2.25 / (n * n))
    passed = {"ad_pass": F.col("a2") < critical, "sw_pass": F.col("sw_p") > ALPHA, "ks_pass": F.col("ks_p") > ALPHA, "skew_pass": F.abs("skew") < 1, "kurt_pass": F.abs("kurt") < 1}
    t = t.withColumns({"ad_critical": F.when(n > 0, critical)} | {c: F.coalesce(x, F.lit(False)) for c, x in passed.items()})
    votes = sum((F.col(c).cast("int") for c in passed), F.lit(0))
    t = t.withColumn("n_passed", votes)
    skew = F.col("skew")
    size = F.abs(skew)
    return t.withColumns({"is_normal": F.when(n >= 3, F.col("n_passed") >= 3), "confidence": F.when(n >= 3, F.when(F.col("n_passed") >= 4, "High").when(F.col("n_passed") >= 3, "Medium").otherwise("Low")), "advice": F.when(size > 2, "Highly skewed: transform the data or use non-normal methods").when(size > 1, "Moderately skewed: consider a transformation").otherwise("No transformation is called for"), "transformation": F.when(skew > 1, "log").when(skew < -1, "square").otherwise("box-cox")})


def _power(u: Column, t: Column, shift: Column) -> tuple[Column, Column, Column]:
    """(exp(lambda t) - 1) / lambda with its first and second derivative by lambda, u = lambda t; all times exp(-shift). Power series where u is small."""
    e, c = F.exp(u - shift), F.exp(-shift)
    near = F.abs(u) < 0.3

    def series(k: int) -> Column:
        out = F.lit(0.0)
        for j in range(k + 12, k - 1, -1):  # Horner's scheme over j (j - 1) .. (j - k + 1) u^(j - k) / (j + 1)!
            out = out * u + math.perm(j, k) / math.factorial(j + 1)
        return out * c

    some = F.when(~near, u)
    first = F.when(near, series(0)).otherwise((e - c) / some)
    second = F.when(near, series(1)).otherwise((u * e - (e - c)) / (some * some))
    third = F.when(near, series(2)).otherwise((u * u * e - 2 * u * e + 2 * (e - c)) / (some * some * some))
    return t * first, t * t * second, t * t * t * third


def _slopes(v: Column, cov: Column, var1: Column, cov2: Column) -> tuple[Column, Column]:
    """First and second derivative of -ln(variance) / 2, from the variance of y, its covariance with y', the variance of y', and the covariance of y and y''."""
    r = cov / v
    return -r, -(var1 + cov2) / v + 2 * r * r


def box_cox(df: DataFrame, value: str, groups: Sequence[str] = (), low: float = -2.0, high: float = 2.0, rounds: int = 60) -> DataFrame:
    """box_cox_lambda of each group whose values are all positive and not all equal, of the greatest likelihood.

    The likelihood is concave in lambda, so Newton's steps on its derivative lead to the one maximum. The first step, from
    lambda 0, needs only the moments of the logarithms. Each further one is a pass with four sums, which give the first and
    second derivative. A step that leaves the bracket, whose ends the signs of the derivative move, halves it instead.

    The bracket covers [low, high] and all that can be best beyond: with logarithms l about their mean, a
    transformed group's values span at least (exp(a) - 1) / lambda for a = lambda max(l), which is exp(a / 2) max(l) at
    least; their variance is at least that span squared over 2 n, and beyond a = 2 ln(sqrt(2 n var(l)) / max(l)) greater
    than at lambda 0. Below 0 it is the same with min(l).
    """
    x, logs = F.col(value), F.ln(value)
    moments_ = [F.min(x).alias("_low"), F.avg(logs).alias("_mean"), F.min(logs).alias("_least"), F.max(logs).alias("_most"), F.var_pop(logs).alias("_v"), F.skewness(logs).alias("_skew"), F.kurtosis(logs).alias("_kurt"), F.count(x).alias("_n")]
    found = grouped(df, groups).agg(*moments_).filter("_low > 0 and _most > _mean and _least < _mean")
    found = found.withColumns({"_least": F.col("_least") - F.col("_mean"), "_most": F.col("_most") - F.col("_mean")})
    farthest = lambda end: 2 * F.greatest(F.ln(F.sqrt(2 * F.col("_n") * F.col("_v")) / F.abs(end)), F.lit(0.0)) / F.col(end)
    found = found.withColumns({"_from": F.least(F.lit(low), farthest("_least")), "_to": F.greatest(F.lit(high), farthest("_most"))})
    v, m3 = F.col("_v"), F.col("_skew") * F.pow("_v", F.lit(1.5))
    m4 = (F.col("_kurt") + 3) * v * v
    slope, bend = _slopes(v, m3 / 2, (m4 - v * v) / 4, m4 / 3)  # at 0, y' is l^2 / 2 and y'' is l^3 / 3

    def stepped(lam: Column, slope: Column, bend: Column) -> dict[str, Column]:
        a, b = F.when(slope >= 0, lam).otherwise(F.col("_from")), F.when(slope <= 0, lam).otherwise(F.col("_to"))
        newton = lam - slope / F.when(bend < 0, bend)
        middle = F.sinh((F.asinh(a) + F.asinh(b)) / 2)
        new = F.when(slope == 0, lam).when((newton > a) & (newton < b), newton).otherwise(middle)
        return {"_lam": new, "_step": F.abs(new - lam) / (1 + F.abs(lam)), "_from": a, "_to": b}

    found = found.withColumns(stepped(F.lit(0.0), slope, bend))
    state = ["_mean", "_least", "_most", "_lam", "_step", "_from", "_to"]
    found = settled(found.select(*groups, *state))
    rows = df.filter(x > 0).select(*groups, logs.alias("_l"))
    # what the passes share, made once: the columns of a trial, its sums, and the step that follows from them
    lam, kept = F.col("_lam"), [F.first(c).alias(c) for c in state]
    scaled = {"_t": F.col("_l") - F.col("_mean")}, {"_u": lam * F.col("_t"), "_shift": F.greatest(lam * F.col("_most"), lam * F.col("_least"))}
    trial = [c.alias(name) for c, name in zip(_power(F.col("_u"), F.col("_t"), F.col("_shift")), ("_y", "_y1", "_y2"), strict=True)]
    sums = [F.var_pop("_y").alias("_v"), F.covar_pop("_y", "_y1").alias("_c1"), F.var_pop("_y1").alias("_v1"), F.covar_pop("_y", "_y2").alias("_c2")]
    step = stepped(lam, *_slopes(*(F.col(c) for c in ("_v", "_c1", "_v1", "_c2"))))
    for _ in range(rounds):
        if found.filter("_step > 1e-6").isEmpty():  # what such a step leaves is about its square
            break
        tried = with_limits(rows, found, groups).withColumns(scaled[0]).withColumns(scaled[1]).select(*groups, *state, *trial)
        found = settled(grouped(tried, groups).agg(*sums, *kept).withColumns(step).select(*groups, *state))
    return found.select(*groups, F.col("_lam").alias("box_cox_lambda"))


def qq(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Normal quantiles of i / (n + 1) against sorted values, with the reference line."""
    rows = normal_scores(df, value, groups).withColumn("p", F.col("i") / (F.col("n") + 1)).withColumn("quantile", F.expr(quantile_sql("p")))
    return rows.select(*groups, "i", "quantile", F.col(value).alias("value"), (F.col("mean") + F.col("sd") * F.col("quantile")).alias("line"))


def histogram(df: DataFrame, value: str, groups: Sequence[str] = (), bins: int = 30) -> DataFrame:
    """bin, low, high, n: equal widths from the least to the greatest value, which is in the last bin."""
    edges = grouped(df, groups).agg(F.min(value).alias("least"), F.max(value).alias("most"))
    rows = with_limits(df.filter(F.col(value).isNotNull()), edges, groups)
    width = (F.col("most") - F.col("least")) / bins
    number = F.least(F.coalesce(F.floor(ratio(F.col(value) - F.col("least"), width)), F.lit(0)), F.lit(bins - 1)).cast("int")
    out = rows.groupBy(*groups, number.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.first("least").alias("least"), F.first("most").alias("most"))
    return out.select(*groups, "bin", (F.col("least") + F.col("bin") * width).alias("low"), (F.col("least") + (F.col("bin") + 1) * width).alias("high"), "n")


def normal_curve(df: DataFrame, value: str, groups: Sequence[str] = (), points: int = 200) -> DataFrame:
    """x, density: the fitted normal density at equal steps from the least to the greatest value."""
    t = grouped(df, groups).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    t = t.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    t = t.withColumn("x", F.col("least") + F.col("i") * (F.col("most") - F.col("least")) / (points - 1))
    z = (F.col("x") - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd"))
    return t.select(*groups, "i", "x", (F.exp(-z * z / 2) / (F.when(F.col("sd") > 0, F.col("sd")) * math.sqrt(2 * math.pi))).alias("density"))


def box_plot(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """least, q1, median, q3, most, mean, sd; quartiles are exact, and no task sorts a large group."""
    q = percentiles(df, value, (0.25, 0.5, 0.75), groups)
    out = grouped(df, groups).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    out = out.join(q, list(groups), "left") if groups else out.join(F.broadcast(q), F.lit(True), "left")  # a row for each group on either side
    return out.select(*groups, "least", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "most", "mean", "sd")
