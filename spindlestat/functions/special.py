"""Distribution functions as SQL text, for Spark and any other engine; and the trend count, in numpy for one block of rows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

# W. J. Cody's rational approximations of erf and erfc (1969), for arguments up to 0.46875, up to 4, and beyond.
ERF_P = (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1)
ERF_Q = (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03)
ERFC_P = (5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8)
ERFC_Q = (1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03)
TAIL_P = (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2)
TAIL_Q = (2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)
# P. J. Acklam's rational approximation of the normal quantile.
QUANTILE_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
QUANTILE_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
QUANTILE_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
QUANTILE_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def _poly(factors, x: str) -> str:
    """Horner's scheme as SQL; the first factor is of the highest power."""
    out = f"{factors[0]!r}e0" if "e" not in repr(factors[0]) else repr(factors[0])
    for f in factors[1:]:
        out = f"({out} * {x} + ({f!r}))"
    return out


def upper_tail_sql(z: str) -> str:
    """SQL for P(normal > z), accurate far into the tail; z must be a column or a number."""
    y = f"(abs({z}) / 1.4142135623730951e0)"
    sq = f"({y} * {y})"
    small = f"(1e0 - {y} * {_poly((ERF_P[4], *ERF_P[:4]), sq)} / {_poly((1.0, *ERF_Q), sq)})"
    middle = f"(exp(-{sq}) * {_poly((ERFC_P[8], *ERFC_P[:8]), y)} / {_poly((1.0, *ERFC_Q), y)})"
    inv = f"(1e0 / {sq})"
    far = f"(exp(-{sq}) / {y} * (0.5641895835477563e0 - {inv} * {_poly((TAIL_P[5], *TAIL_P[:5]), inv)} / {_poly((1.0, *TAIL_Q), inv)}))"
    erfc = f"CASE WHEN {y} <= 0.46875e0 THEN {small} WHEN {y} <= 4e0 THEN {middle} ELSE {far} END"
    return f"(CASE WHEN {z} >= 0 THEN 0.5e0 * ({erfc}) ELSE 1e0 - 0.5e0 * ({erfc}) END)"


def quantile_sql(p: str) -> str:
    """SQL for the normal quantile of p (0 < p < 1), to 9 digits."""
    q, r = f"({p} - 0.5e0)", f"(({p} - 0.5e0) * ({p} - 0.5e0))"
    middle = f"({_poly(QUANTILE_A, r)} * {q} / {_poly(QUANTILE_B, r)})"
    tail = lambda x: f"({_poly(QUANTILE_C, x)} / {_poly(QUANTILE_D, x)})"
    low, high = f"sqrt(-2e0 * ln({p}))", f"sqrt(-2e0 * ln(1e0 - {p}))"
    return f"(CASE WHEN {p} < 0.02425e0 THEN {tail(low)} WHEN {p} > 0.97575e0 THEN -{tail(high)} ELSE {middle} END)"


def upper_tail(column: str) -> Column:
    return F.expr(upper_tail_sql(column))


#: Degrees of freedom from which Student's t is a transformed normal variable; below, the finite sums hold for whole numbers of degrees.
T_LARGE = 30


def t_normal_sql(t: str, df: str) -> str:
    """SQL for the normal score whose two tails are those of Student's t, by G. W. Hill's expansion (1970); to 10 digits from T_LARGE degrees on."""
    a = f"({df} - 0.5e0)"
    y = f"({a} * ln(1e0 + {t} * {t} / {df}))"
    b = f"(48e0 * {a} * {a})"
    return f"((((((-0.4e0 * {y} - 3.3e0) * {y} - 24e0) * {y} - 85.5e0) / (0.8e0 * {y} * {y} + 100e0 + {b}) + {y} + 3e0) / {b} + 1e0) * sqrt({y}))"


def t_two_sided_sql(t: str, df: str, z: str) -> str:
    """SQL for P(|Student t with df degrees| > |t|), null without degrees; df is a whole number, and z a column with t_normal_sql(t, df)."""
    c2 = f"({df} / ({df} + {t} * {t}))"
    s, angle = f"(abs({t}) / sqrt({df} + {t} * {t}))", f"atan(abs({t}) / sqrt({df}))"
    odd, even = "0e0", "0e0"
    for j in range(T_LARGE // 2, 0, -1):  # sums of j terms, each the one before times a factor and the squared cosine
        odd = f"(CASE WHEN {df} >= {2 * j + 3} THEN {2 * j}e0 / {2 * j + 1}e0 * {c2} * (1e0 + {odd}) ELSE 0e0 END)"
        even = f"(CASE WHEN {df} >= {2 * j + 2} THEN {2 * j - 1}e0 / {2 * j}e0 * {c2} * (1e0 + {even}) ELSE 0e0 END)"
    small = f"CASE WHEN {df} % 2 = 0 THEN 1e0 - {s} * (1e0 + {even}) WHEN {df} = 1 THEN 1e0 - 0.6366197723675814e0 * {angle} ELSE 1e0 - 0.6366197723675814e0 * ({angle} + {s} * sqrt({c2}) * (1e0 + {odd})) END"
    return f"(CASE WHEN {t} IS NULL OR {df} IS NULL THEN NULL WHEN {df} >= {T_LARGE} THEN 2e0 * {upper_tail_sql(z)} WHEN {df} >= 1 THEN greatest({small}, 0e0) END)"


def with_t_p_value(df: DataFrame, t: str, degrees: str, name: str = "p_value") -> DataFrame:
    """Adds the two-sided p-value of a column t with that many degrees of freedom; infinite t have 0."""
    x, n = F.col(t).cast("double"), F.col(degrees).cast("double")
    rows = df.withColumns({"_t": F.when(F.abs(x) < float("inf"), x), "_df": F.when(n >= 1, n)}).withColumn("_z", F.expr(t_normal_sql("_t", "_df")))
    return rows.withColumn(name, F.when((F.abs(x) == float("inf")) & (n >= 1), 0.0).otherwise(F.expr(t_two_sided_sql("_t", "_df", "_z")))).drop("_t", "_df", "_z")


#: Sizes up to which the one-sided law of Kolmogorov and Smirnov is summed up exactly.
KS_SMALL = 500
#: P(D+ > d) for n values (Birnbaum and Tingey's sum) in Spark's SQL, and in that of engines with lambdas over lists and lgamma.
KS_ONE_SIDED = "({d} * aggregate(sequence(0, CAST(floor({n} * (1e0 - {d})) AS INT)), named_struct('c', 1e0, 's', 0e0), (a, j) -> named_struct('c', a.c * ({n} - j) / (j + 1), 's', a.s + a.c * power({d} + j / {n}, j - 1) * power(greatest(1e0 - {d} - j / {n}, 0e0), {n} - j)), a -> a.s))"
KS_ONE_SIDED_DUCKDB = "({d} * list_sum(list_transform(range(0, CAST(floor({n} * (1e0 - {d})) AS BIGINT) + 1), lambda j: exp(lgamma({n} + 1) - lgamma(j + 1) - lgamma({n} - j + 1)) * power({d} + j / {n}, j - 1) * power(greatest(1e0 - {d} - j / {n}, 0e0), {n} - j))))"


def ks_sql(d: str, n: str, one_sided: str = KS_ONE_SIDED) -> str:
    """SQL for P(D > d) of the two-sided one-sample Kolmogorov-Smirnov statistic; d and n are doubles.

    Beyond KS_SMALL values, the limit law with Stephens' correction. Up to there, both one-sided tails, exactly, less the
    chance that both are exceeded, from the limit law, where that is small; else the limit law with J. Vrbik's correction.
    Exact to 2e-6 below 0.06, where verdicts are made, to 2e-4 below 0.2, and to 0.008 anywhere from five values on.
    """
    x = f"({d} * (sqrt({n}) + 0.12e0 + 0.11e0 / sqrt({n})))"
    v = f"({d} * sqrt({n}) + 1e0 / (6e0 * sqrt({n})) + ({d} * sqrt({n}) - 1e0) / (4e0 * {n}))"
    terms = lambda x, first: " ".join(f"{'+' if k % 2 else '-'} 2e0 * exp(-{2 * k * k}e0 * {x} * {x})" for k in range(first, 9))
    near = lambda x: " + ".join(f"exp(-{(2 * k - 1) ** 2}e0 * 1.2337005501361697e0 / ({x} * {x}))" for k in range(1, 5))
    limit = lambda x: f"(CASE WHEN {x} < 0.75e0 THEN 1e0 - 2.5066282746310002e0 / {x} * ({near(x)}) ELSE 0e0 {terms(x, 1)} END)"
    small = f"CASE WHEN {v} < 1e0 THEN {limit(v)} ELSE 2e0 * {one_sided.format(d=d, n=n)} {terms(x, 2)} END"
    return f"(CASE WHEN {d} IS NULL OR {n} IS NULL OR {n} <= 0 THEN NULL WHEN {d} <= 0.5e0 / {n} THEN 1e0 WHEN {d} >= 1 THEN 0e0 WHEN {n} > {KS_SMALL} THEN least(1e0, greatest(0e0, {limit(x)})) WHEN {n} > 0 THEN least(1e0, greatest(0e0, {small})) END)"


# Fixed values of P. Royston's algorithm AS R94 for the Shapiro-Wilk test.
SW_LAST = (-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, 0.0)
SW_NEXT = (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0)
SW_SMALL_G = (0.459, -2.273)
SW_SMALL_MEAN, SW_SMALL_SD = (-0.0006714, 0.025054, -0.39978, 0.544), (-0.0020322, 0.062767, -0.77857, 1.3822)
SW_MEAN, SW_SD = (0.0038915, -0.083751, -0.31082, -1.5861), (0.0030302, -0.082676, -0.4803)


SW_MOST = 5000


def shapiro_scores_sql(i: str, n: str) -> str:
    """SQL for the expected normal score of rank i of n."""
    return quantile_sql(f"(({i} - 0.375e0) / ({n} + 0.25e0))")


def shapiro_steps() -> list[dict[str, str]]:
    """The Shapiro-Wilk test as SQL, step by step: each dict adds columns to those before, the last ones sw_w and sw_p.

    The first takes n; total and inner, the sums of squared scores and of scores times sorted values; x1, x2, x3, xm and xn, the
    first three values and the last two; and ss, the squares about the mean. Null unless there are 3 to SW_MOST values, not all equal.
    """
    u, y, ln_n = "(1e0 / sqrt(n))", "sw_y", "ln(n)"
    outer = lambda ends: f"sqrt(({'total' + ends}) / "
    return [
        {"m1": shapiro_scores_sql("1e0", "n"), "m2": shapiro_scores_sql("2e0", "n")},
        {"a1": f"({_poly(SW_LAST, u)} - m1 / sqrt(total))", "a2_": f"({_poly(SW_NEXT, u)} - m2 / sqrt(total))"},
        {
            "sw_a": f"CASE WHEN n = 3 THEN 0.7071067811865476e0 * (xn - x1) "
            f"WHEN n <= 5 THEN (inner_ - m1 * (x1 - xn)) / {outer(' - 2e0 * m1 * m1')}(1e0 - 2e0 * a1 * a1)) + a1 * (xn - x1) "
            f"ELSE (inner_ - m1 * (x1 - xn) - m2 * (x2 - xm)) / {outer(' - 2e0 * m1 * m1 - 2e0 * m2 * m2')}(1e0 - 2e0 * a1 * a1 - 2e0 * a2_ * a2_)) + a1 * (xn - x1) + a2_ * (xm - x2) END"
        },
        {"sw_w": f"CASE WHEN n BETWEEN 3 AND {SW_MOST} AND xn > x1 AND ss > 0 THEN least(1e0, sw_a * sw_a / ss) END"},
        {"sw_y": "ln(greatest(1e0 - sw_w, 1e-300))", "sw_g": _poly(SW_SMALL_G, "n")},
        {"sw_z": f"CASE WHEN n <= 11 THEN (CASE WHEN {y} < sw_g THEN (-ln(sw_g - {y}) - {_poly(SW_SMALL_MEAN, 'n')}) / exp({_poly(SW_SMALL_SD, 'n')}) END) ELSE ({y} - {_poly(SW_MEAN, ln_n)}) / exp({_poly(SW_SD, ln_n)}) END"},
        {"sw_p": f"CASE WHEN sw_w IS NULL THEN NULL WHEN n = 3 THEN greatest(0e0, 1.909859317102744e0 * (asin(sqrt(sw_w)) - 1.0471975511965976e0)) WHEN sw_z IS NULL THEN 1e-19 ELSE {upper_tail_sql('sw_z')} END"},
    ]


def kendall_s(values: np.ndarray) -> int:
    """Pairs that go up minus pairs that go down, in n log n steps: merges of sorted runs count both."""
    x = np.asarray(values, float)
    x = np.unique(x[~np.isnan(x)], return_inverse=True)[1] if len(x) else x
    total, width, n = 0, 1, len(x)
    runs = x.copy()
    while width < n:
        for at in range(0, n - width, 2 * width):
            left, right = runs[at : at + width], runs[at + width : at + 2 * width]
            total += int(np.searchsorted(left, right, "left").sum() - (len(left) - np.searchsorted(left, right, "right")).sum())
            runs[at : at + 2 * width] = np.sort(runs[at : at + 2 * width], kind="stable")
        width *= 2
    return total
