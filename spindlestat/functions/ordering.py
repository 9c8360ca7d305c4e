"""Positions and predecessors of rows in series, with or without group columns; no task has to hold a long series."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from .joins import with_group
from .lineage import cut_lineage

#: Rows of a series that may be a window, or a task, by themselves. Longer series are sorted by range and cut.
STRIDE = 1 << 20


def longest(df: DataFrame, group_cols: Sequence[str] = ()) -> int:
    """The number of rows of the largest group."""
    return df.groupBy(*group_cols).count().agg(F.max("count")).first()[0] or 0


def _ranged(df: DataFrame, order_cols: Sequence[str], group_cols: Sequence[str], name: str) -> DataFrame:
    """positions() of long series: one range sort by group and order, whose partitions are numbered on from the sizes of those before; a group's first number is then taken off."""
    keys = [*group_cols, *order_cols]
    ordered = cut_lineage(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("_part", F.shiftright("_at", 33))
    sizes = sorted(tuple(r) for r in ordered.groupBy("_part").count().collect())
    starts = [(p, s) for (p, _), s in zip(sizes, accumulate((n for _, n in sizes), initial=0), strict=False)]
    starts = df.sparkSession.createDataFrame(starts, "_part long, _start long")  # a row for each partition
    rows = ordered.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_part", "_start")
    if not group_cols:
        return rows
    first = rows.groupBy(*group_cols).agg((F.min(name) - 1).alias("_first"))
    return with_group(rows, first, group_cols).withColumn(name, F.col(name) - F.col("_first")).drop("_first")


def positions(df: DataFrame, order_cols: Sequence[str], group_cols: Sequence[str] = (), name: str = "seq", size: int | None = None) -> DataFrame:
    """Adds the 1-based position within the group; rows with a null group are left out. size: rows of the largest group, counted here unless given."""
    df = df.dropna(subset=list(group_cols)) if group_cols else df
    if (longest(df, group_cols) if size is None else size) > STRIDE:
        return _ranged(df, order_cols, group_cols, name)
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group_cols).orderBy(*order_cols)).cast("long"))


def over_strides(rows: DataFrame, group_cols: Sequence[str], back: int, columns: dict[str, Callable[[WindowSpec], Column]]) -> DataFrame:
    """Adds columns over windows that look back at most `back` rows (STRIDE at most) from a row with a position `seq`.

    A window is a stride of a group, and the last rows of each stride are copied to the next one.
    """
    stride = F.floor((F.col("seq") - 1) / STRIDE)
    at_end = (F.col("seq") - 1) % STRIDE >= STRIDE - back
    rows = rows.withColumn("_stride", F.explode(F.when(at_end, F.array(stride, stride + 1)).otherwise(F.array(stride))))
    w = Window.partitionBy(*group_cols, "_stride").orderBy("seq")
    return rows.withColumns({name: f(w) for name, f in columns.items()}).filter(stride == F.col("_stride")).drop("_stride")


def with_previous(df: DataFrame, value: str, order_cols: Sequence[str], group_cols: Sequence[str] = (), name: str = "previous") -> DataFrame:
    """Adds seq and the value of the row before (null for the first row, and where that value is null); rows with a null group are left out."""
    df = df.dropna(subset=list(group_cols)) if group_cols else df
    if longest(df, group_cols) > STRIDE:
        return over_strides(_ranged(df, order_cols, group_cols, "seq"), group_cols, 1, {name: lambda w: F.lag(value).over(w)})
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumns({"seq": F.row_number().over(w).cast("long"), name: F.lag(value).over(w)})
