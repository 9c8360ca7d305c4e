"""Exact forms of the distribution functions, in plain Python and numpy, that the SQL forms are compared with."""

from __future__ import annotations

import math

import numpy as np

from spindlestat.functions.special import SW_LAST, SW_MEAN, SW_NEXT, SW_SD, SW_SMALL_G, SW_SMALL_MEAN, SW_SMALL_SD


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
    f = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            f *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * f


def t_two_sided(t: float, df: float) -> float:
    """P(|Student t with df degrees| > |t|)."""
    if t is None or df is None or not df > 0 or math.isnan(t):
        return math.nan
    return 0.0 if math.isinf(t) else incomplete_beta(df / 2, 0.5, df / (df + t * t))


def ks_two_sided(d: float, n: int) -> float:
    """P(D > d) of the two-sided one-sample Kolmogorov-Smirnov statistic: exact by a matrix power for n up to 500, the limit law with Stephens' correction beyond."""
    if not n or d is None or math.isnan(d):
        return math.nan
    if d <= 0 or d >= 1:
        return float(d <= 0)
    if n > 500:
        x = d * (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n))
        return float(min(1, max(0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))))
    k = math.ceil(n * d)
    h = k - n * d
    m = 2 * k - 1
    i, j = np.indices((m, m))
    power = i - j + 1
    base = (power >= 0).astype(float)
    edge = h ** np.arange(1, m + 1)
    base[:, 0] -= edge
    base[m - 1, :] -= edge[::-1]
    base[m - 1, 0] += max(2 * h - 1, 0) ** m
    base /= np.exp([[math.lgamma(max(p, 0) + 1) for p in row] for row in power])
    out, scale = np.eye(m), 0
    for bit in bin(n)[2:]:
        out = out @ out
        scale *= 2
        if bit == "1":
            out = out @ base
        top = abs(out).max()
        if top > 1e100:
            out, scale = out / 1e100, scale + 100
    log_p = math.log(max(out[k - 1, k - 1], 1e-300)) + scale * math.log(10) + math.lgamma(n + 1) - n * math.log(n)
    return float(min(1, max(0, 1 - math.exp(min(0, log_p)))))


def normal_quantile(p: float) -> float:
    """By Newton's steps on erfc from a rough start; for a few values."""
    z = 0.0
    for _ in range(60):
        step = (0.5 * math.erfc(-z / math.sqrt(2)) - p) / max(math.exp(-z * z / 2) / math.sqrt(2 * math.pi), 1e-300)
        step = max(-1.0, min(1.0, step))
        z -= step
        if abs(step) < 1e-15:
            break
    return z


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """W and its p-value for 3 to 5000 values; NaN otherwise, or if all are equal."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if not 3 <= n <= 5000 or x[0] == x[-1]:
        return math.nan, math.nan
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0, math.sqrt(0.5)])
    else:
        m = np.array([normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n // 2 + 1)])
        total = 2 * float(m @ m)
        u = 1 / math.sqrt(n)
        last = np.polyval(SW_LAST, u) - m[0] / math.sqrt(total)
        half = np.empty(len(m))
        if n > 5:
            following = np.polyval(SW_NEXT, u) - m[1] / math.sqrt(total)
            scale = math.sqrt((total - 2 * m[0] ** 2 - 2 * m[1] ** 2) / (1 - 2 * last**2 - 2 * following**2))
            half[:2], half[2:] = (last, following), -m[2:] / scale
        else:
            scale = math.sqrt((total - 2 * m[0] ** 2) / (1 - 2 * last**2))
            half[0], half[1:] = last, -m[1:] / scale
        a = np.concatenate([-half, [0.0] * (n % 2), half[::-1]])
    centred = x - x.mean()
    w = min(1.0, float(a @ x) ** 2 / float(centred @ centred))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y = math.log(max(1 - w, 1e-300))
    if n <= 11:
        g = np.polyval(SW_SMALL_G, n)
        if y >= g:
            return w, 1e-19
        y, mean, sd = -math.log(g - y), np.polyval(SW_SMALL_MEAN, n), math.exp(np.polyval(SW_SMALL_SD, n))
    else:
        mean, sd = np.polyval(SW_MEAN, math.log(n)), math.exp(np.polyval(SW_SD, math.log(n)))
    return w, 0.5 * math.erfc((y - mean) / sd / math.sqrt(2))
