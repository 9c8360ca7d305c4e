"""Extension: charts on streams. Limits are frozen, from a batch; counts are of tumbling windows with a watermark."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.common import beyond, with_limits


def flagged(stream: DataFrame, limits: DataFrame, value: str, groups: Sequence[str]) -> DataFrame:
    """The stream's rows with the frozen limits of their group and the reason why they are out, if they are. No state."""
    return with_limits(stream, limits, groups).withColumn("reason", beyond(F.col(value), F.col("ucl"), F.col("lcl")))


def window_counts(stream: DataFrame, time: str, test: str, groups: Sequence[str] = (), length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, defects, n of each window: input of C, U and P charts. Rows later than `late` are dropped by the watermark."""
    out = stream.withWatermark(time, late).groupBy(F.window(time, length), *groups).agg(F.sum(F.expr(test).cast("long")).alias("defects"), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), *groups, "defects", "n")


def moving_ranges(stream: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """group, order, value, mr on a stream: the last value of each group is kept as state. Rows of a micro-batch are taken in the given order."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    schema = f"{group} {kinds[group]}, {order} {kinds[order]}, {value} double, mr double"

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        last = state.get[0] if state.exists else None
        before = rows[value].shift(1)
        before.iloc[0] = float("nan") if last is None else last
        state.update((None if pd.isna(rows[value].iloc[-1]) else float(rows[value].iloc[-1]),))
        yield pd.DataFrame({group: key[0], order: rows[order], value: rows[value].astype(float), "mr": (rows[value] - before).abs()})

    return stream.select(group, order, value).groupBy(group).applyInPandasWithState(step, schema, "last double", "append", GroupStateTimeout.NoTimeout)
