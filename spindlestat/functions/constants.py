"""Control-chart constants."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Factors by subgroup size, and what holds for any other size.
A2, A2_ELSE = {2: 1.88, 3: 1.02, 4: 0.73, 5: 0.58, 6: 0.48, 7: 0.42, 8: 0.37, 9: 0.34}, 0.31
D3, D3_ELSE = {7: 0.08, 8: 0.14, 9: 0.18}, 0.0
D4, D4_ELSE = {2: 3.27, 3: 2.57, 4: 2.28, 5: 2.11, 6: 2.00, 7: 1.92, 8: 1.86, 9: 1.82}, 1.78
D2_GAGE, D2_GAGE_ELSE = {2: 1.128, 3: 1.693, 4: 2.059, 5: 2.326}, 2.326
D2_WITHIN, D2_WITHIN_ELSE = {2: 1.128, 3: 1.693, 4: 2.059, 5: 2.326, 6: 2.534, 7: 2.704, 8: 2.847, 9: 2.970, 10: 3.078}, 3.0
INDIVIDUALS, MOVING_RANGE = 2.66, 3.27


def by_size(table: dict[int, float], other: float, size: Column) -> Column:
    out = F.lit(other)
    for n, v in table.items():
        out = F.when(size == n, v).otherwise(out)
    return out


def sql_by_size(table: dict[int, float], other: float, size: str) -> str:
    return "CASE " + " ".join(f"WHEN {size} = {n} THEN {v}" for n, v in table.items()) + f" ELSE {other} END"


def c4(n: int) -> float:
    """What the mean of sample deviations of n normal values is, in sigmas."""
    return math.sqrt(2 / (n - 1)) * math.exp(math.lgamma(n / 2) - math.lgamma((n - 1) / 2))


def s_factors(n: int) -> tuple[float, float, float]:
    """A3, B3, B4 of an Xbar-S chart."""
    c = c4(n)
    spread = 3 * math.sqrt(1 - c * c) / c
    return 3 / (c * math.sqrt(n)), max(0.0, 1 - spread), 1 + spread


#: Sizes for which Xbar-S factors are written out; beyond them the limit of large n is used.
S_SIZES = range(2, 101)


def s_factor(which: int, size: Column) -> Column:
    large = (F.lit(3.0) / F.sqrt(size), F.greatest(F.lit(0.0), 1 - 3 / F.sqrt(2 * size)), 1 + 3 / F.sqrt(2 * size))[which]
    table = F.create_map(*[F.lit(x) for n in S_SIZES for x in (n, s_factors(n)[which])])
    return F.coalesce(F.try_element_at(table, size.cast("int")), large)
