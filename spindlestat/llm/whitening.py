"""Embedding whitening by a singular value decomposition: blockwise TSQR, then one-sided Jacobi rotations.

1. Entries become whole numbers, floor(scale * c). The fit list is each distinct vector once, n of them, with sums S; both are exact.
2. Each task turns its rows of the fit list, centred as (n * x - S) / n, into an upper triangle R block by block: R is the
   triangle of the QR decomposition of the R so far and the next block. The triangles of tasks are joined in the same way,
   FAN at a time, until one is left. It is as wide and as high as vectors are long, whatever the number of rows.
3. Plane rotations make the columns of R orthogonal, in rounds of disjoint pairs (each column meets each other once a
   sweep), until no pair is further from it than rounding. Their product holds the components; the norms of R's columns
   then are singular values, and their squares over n the variances along the components. They never pass through a
   covariance matrix, so small ones are as accurate as large ones.
4. Each row's vector is projected on the first components and divided by the standard deviations.

Rows whose vector is null, empty, or holds a null or a non-finite entry are dropped. So are rows whose vector is not of
the most frequent length (the shorter one at a tie). Repeated rows, and rows without an id, stay as they are. Components of
equal variance are in any order and direction within their plane; signs are such that a component's greatest entry is
positive. A component without variance (its standard deviation is below RANK of the greatest) has a null `whitened`, and
stays out of `identity_error`, which is null if no component is left. There are no components beyond a vector's length. An
empty table gives an empty result. `deviation` is null where it exceeds a long. Other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut_lineage, record

#: Triangles that are joined by one task; rows of a block; share of the greatest deviation below which there is none.
FAN, BLOCK, RANK = 16, 2048, 1e-12
LONG = (1 << 63) - 1


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * c) of each entry; null for a vector that can't take part."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    entries = F.transform(vector, lambda c: c.cast("double"))
    return F.when((F.size(vector) > 0) & ~F.exists(entries, bad), F.transform(entries, lambda c: F.floor(c * scale).cast("long")))


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of equal lengths, as whole numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """(n * x - S) / n, with an exact difference."""
    if n * int(np.abs(x).max(initial=0)) < LONG // 4 and max(map(abs, sums), default=0) < LONG // 4:
        return (n * x - np.array(sums, np.int64)) / n
    return np.array([[float(n * int(c) - s) / n for c, s in zip(row, sums, strict=True)] for row in x])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of (n * x - S)^2, exact."""
    top = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if x.shape[1] * top * top <= LONG:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    found = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return [d if d <= LONG else None for d in found]


def column_sums(fit: DataFrame) -> list[int]:
    """The exact sum of each entry over all rows; a task adds up its own first."""
    schema = pa.schema([("i", pa.int64()), ("s", pa.decimal128(38, 0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] = []
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"))
                small = int(np.abs(x).max(initial=0)) <= LONG // len(x)
                found = x.sum(axis=0).tolist() if small else [sum(c) for c in zip(*x.tolist(), strict=True)]
                total = [a + b for a, b in zip(total or [0] * len(found), found, strict=True)]
        yield record(schema, i=list(range(len(total))), s=[Decimal(t) for t in total])

    rows = fit.select("x").mapInArrow(run, "i long, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    return [int(r["s"]) for r in rows]


def triangles(fit: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """(part, r): a triangle for each task that has rows, row after row."""
    schema = pa.schema([("part", pa.int64()), ("r", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, part = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if r is None:
                part = batch.column("part")[0].as_py()
            for at in range(0, batch.num_rows, BLOCK):
                block = centred(matrix(batch.column("x").slice(at, BLOCK)), n, sums)
                r = triangle(block if r is None else np.vstack([r, block]))
        if r is not None:
            yield record(schema, part=[part], r=[r.ravel()])

    return fit.select(F.spark_partition_id().cast("long").alias("part"), "x").mapInArrow(run, "part long, r array<double>")


def joined(rs: DataFrame, width: int) -> np.ndarray:
    """One triangle from all: FAN of them meet in a task, then FAN of the results."""
    schema = pa.schema([("part", pa.int64()), ("r", pa.list_(pa.float64()))])

    def run(key: tuple, group: pa.Table) -> pa.Table:
        r = triangle(np.vstack([np.array(x).reshape(-1, width) for x in group.column("r").to_pylist()]))
        return pa.Table.from_batches([record(schema, part=[key[0].as_py()], r=[r.ravel()])])

    rs = cut_lineage(rs)
    while rs.count() > 1:
        rs = cut_lineage(rs.groupBy(F.floor(F.col("part") / FAN).alias("team")).applyInArrow(run, "part long, r array<double>"))
    return np.array(rs.first()["r"]).reshape(-1, width)


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(components as columns, singular values), the greatest first, of a matrix r: one-sided Jacobi."""
    d = r.shape[1]
    u, v = r.copy(), np.eye(d)
    even = d + d % 2
    ring = np.arange(even)  # a round-robin of columns; with an odd number, one pauses
    close = np.finfo(float).eps * max(1, d) ** 0.5
    for _ in range(sweeps):
        still = True
        for _ in range(even - 1):
            p, q = np.minimum(ring[: even // 2], ring[: even // 2 - 1 : -1]), np.maximum(ring[: even // 2], ring[: even // 2 - 1 : -1])
            p, q = p[q < d], q[q < d]
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
            x, y = u[:, p], u[:, q]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            turn = np.abs(xy) > close * np.sqrt(xx) * np.sqrt(yy)
            # a column of rounding errors alone isn't turned
            turn &= (np.minimum(xx, yy) > 0) & (np.abs(xy) > 0)
            if not turn.any():
                continue
            still = False
            p, q, xx, yy, xy = p[turn], q[turn], xx[turn], yy[turn], xy[turn]
            with np.errstate(over="ignore"):
                zeta = (yy - xx) / (2 * xy)
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            c = 1 / np.sqrt(1 + t * t)
            s = c * t
            for m in (u, v):
                a, b = m[:, p], m[:, q]
                m[:, p], m[:, q] = c * a - s * b, s * a + c * b
        if still:
            break
    sigma = np.sqrt((u * u).sum(axis=0))
    order = np.argsort(-sigma, kind="stable")
    v, sigma = v[:, order], sigma[order]
    return v * np.where(v[np.abs(v).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0), sigma


class Whitening:
    """A fitted whitening: n and sums of the fit list, components (columns), variances by component, and identity_error once measured."""

    def __init__(self, n: int, sums: list[int], components: np.ndarray, sigma: np.ndarray, most: int):
        self.n, self.sums = n, sums
        self.variances, self.trace = sigma**2 / n, float((sigma**2).sum()) / n
        self.components = components[:, :most]
        kept = sigma[:most] > RANK * sigma.max(initial=0)
        self.scales = np.where(kept, np.sqrt(n) / np.where(kept, sigma[:most], 1), np.nan)
        self.identity_error: float | None = None

    def apply(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ self.components * self.scales

    def projected(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """keep, deviation, and whitened (an array, NaN where there is no variance) of rows with an x."""
        fields = {f.name: f.dataType for f in rows.schema.fields}
        ddl = ", ".join([*(f"`{c}` {fields[c].simpleString()}" for c in keep), "deviation long", "whitened array<double>"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = matrix(batch.column("x"))
                    found = self.apply(x)
                    out = [batch.column(c) for c in keep]
                    white = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))
                    yield pa.RecordBatch.from_arrays([*out, pa.array(deviations(x, self.n, self.sums), pa.int64()), white], names=[*keep, "deviation", "whitened"])

        return rows.select(*keep, "x").mapInArrow(run, ddl)


def fit(rows: DataFrame, components: int = 4) -> Whitening | None:
    """The whitening of the distinct x of rows (x: arrays of longs of one length); None without rows.

    Only what the length of a vector bounds reaches the driver: sums, one triangle, and the covariance of a few components.
    """
    distinct = cut_lineage(rows.select("x").distinct())
    n = distinct.count()
    if not n:
        return None
    sums = column_sums(distinct)
    v, sigma = jacobi(joined(triangles(distinct, n, sums), len(sums)))
    out = Whitening(n, sums, v, sigma, components)
    kept = np.flatnonzero(~np.isnan(out.scales)).tolist()
    if kept:
        white = out.projected(distinct, []).select(*[F.col("whitened")[i].alias(f"w{i}") for i in kept])
        means = white.agg(*[F.avg(f"w{i}").alias(f"w{i}") for i in kept]).first()
        inner = [(i, j) for i in kept for j in kept if i <= j]
        got = white.agg(*[F.avg((F.col(f"w{i}") - means[f"w{i}"]) * (F.col(f"w{j}") - means[f"w{j}"])).alias(f"c{i}_{j}") for i, j in inner]).first()
        out.identity_error = max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in inner)
    return out


def whitened(table: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: of each row that takes part, as many rows as there are components."""
    rows = table.select(F.col(id_col).alias("vec_id"), whole_numbers(F.col(vector_col), scale).alias("x")).filter("x IS NOT NULL")
    lengths = rows.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), "length").limit(1).collect()
    rows = rows.filter(F.size("x") == (lengths[0]["length"] if lengths else 0))
    model = fit(rows, components)
    ddl = {"component": "int", "n": "long", "whitened": "double", "explained": "double", "identity_error": "double"}
    if model is None:
        out = rows.withColumn("deviation", F.lit(None).cast("long")).withColumns({c: F.lit(None).cast(k) for c, k in ddl.items()})
        return out.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
    shares = [float(e / model.trace) if model.trace else None for e in model.variances[: model.components.shape[1]]]
    out = model.projected(rows, ["vec_id"]).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "w"))
    explained = F.array(*[F.lit(s).cast("double") for s in shares])[F.col("k")]
    return out.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.when(~F.isnan("w"), F.col("w")).alias("whitened"), explained.alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"))
