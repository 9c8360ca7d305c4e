"""Small expressions that all analyses use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.joins import with_group


def ratio(a: Column, b: Column, other: float | None = None) -> Column:
    """a / b; `other` where b is 0."""
    return F.when(b != 0, a / F.when(b != 0, b)).otherwise(F.lit(other).cast("double"))


def grouped(df: DataFrame, groups: Sequence[str]):
    """df by groups; rows with a null key take no part."""
    return df.dropna(subset=list(groups)).groupBy(*groups) if groups else df.groupBy()


def with_limits(rows: DataFrame, limits: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Each row with the limits of its group."""
    return with_group(rows, limits, groups)


def clip(x: Column) -> Column:
    """x, but at least 0; null stays null."""
    return F.when(x < 0, 0.0).otherwise(x)


def beyond(value: Column, ucl: Column, lcl: Column) -> Column:
    return F.when(value > ucl, "Above UCL").when(value < lcl, "Below LCL")
