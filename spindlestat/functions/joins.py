"""Joins of rows with a table that has a row for each group: no task gets all rows of a group, and few groups cost no shuffle of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .lineage import cut_lineage

#: Rows of a few numbers each that are gathered on the driver, and broadcast, at most.
GATHERED = 10_000


def gathered(df: DataFrame, most: int | None = None) -> DataFrame | None:
    """The rows of a small table, computed now and held by the driver; None if there are more than `most` (GATHERED)."""
    most = GATHERED if most is None else most
    rows = df.limit(most + 1).toArrow()
    return df.sparkSession.createDataFrame(rows, df.schema) if rows.num_rows <= most else None


def settled(df: DataFrame) -> DataFrame:
    """The rows, computed now: gathered if they are few, else written to the folder of checkpoints."""
    near = gathered(df)
    return cut_lineage(df) if near is None else near


def with_group(rows: DataFrame, of_group: DataFrame, groups: Sequence[str]) -> DataFrame:
    """rows joined with of_group, which has each group once; groups that it lacks are left out.

    Up to GATHERED groups are broadcast, by an exact count of them. Of more, those with most rows are; each of the others
    has less than 1 / GATHERED of all rows then, and they are joined by shuffle. A stream is joined with the table as it is.
    """
    keys = list(groups)
    if not keys:
        return rows.crossJoin(F.broadcast(of_group))  # one row
    if rows.isStreaming:
        return rows.join(of_group, keys)
    near = gathered(of_group)
    if near is not None:
        return rows.join(F.broadcast(near), keys)
    largest = gathered(rows.groupBy(*keys).count().orderBy(F.desc("count")).limit(GATHERED).select(*keys))
    heavy = gathered(of_group.join(F.broadcast(largest), keys, "left_semi"))
    return rows.join(F.broadcast(heavy), keys).unionByName(rows.join(F.broadcast(largest), keys, "left_anti").join(of_group, keys))
