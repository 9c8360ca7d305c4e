"""What the text operators share: reading tables, walking Arrow batches in small slices, sizing partitions."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.lineage import checkpoint_folder, cut_lineage  # noqa: F401  the operators take them from here

#: Bytes of text that a Python worker turns into Python objects at a time.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that most operators need, under fixed names; a null text counts as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Each batch in pieces of about `most` bytes of `column`; one longer value is a piece by itself."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        i = batch.schema.get_field_index(column)
        lengths = batch.column(i)
        lengths = pc.binary_length(lengths).fill_null(0).to_numpy(zero_copy_only=False)
        start, size = 0, 0
        for row, n in enumerate(lengths.tolist()):
            if size and size + n > most:
                yield batch.slice(start, row - start)
                start, size = row, 0
            size += n + 64
        yield batch.slice(start)


def strings(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return ["" if s is None else s for s in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def raw(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of each text, without decoding them first."""
    col = batch.column(batch.schema.get_field_index(column))
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [b"" if s is None else s for s in col.cast(kind).to_pylist()]


def record(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in schema], schema=schema)


class Memo(dict):
    """A dict that computes what it lacks. trim() makes it the older of two generations when it holds `most` entries, so that common entries outlast rare ones."""

    def __init__(self, make, most: int = 400_000):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def lacking(self, keys: set) -> set:
        """Those of the keys that neither generation holds; the others are in the younger one then."""
        new, old = [k for k in keys if k not in self], self.old
        for key in new:
            if key in old:
                self[key] = old[key]
        return {k for k in new if k not in old}

    def trim(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


#: So many rows of a few numbers each are broadcast at most, after their number has been counted; more are joined by shuffle.
BROADCAST_ROWS = 500_000


def few(df: DataFrame) -> DataFrame:
    """A materialised table, marked for broadcast if its rows are counted to be few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def unused(df: DataFrame, name: str) -> str:
    """A name like this one that no column of df has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def stored(df: DataFrame) -> DataFrame:
    """The rows written as compressed Parquet into the folder of checkpoints, and read back: for tables too wide for a checkpoint. The files go when the application ends."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    gone_at_end(spark, path)
    return spark.read.parquet(path)


def gone_at_end(spark: SparkSession, path: str, table_name: str | None = None) -> None:
    """Hadoop deletes the path when the driver's JVM ends; a table of that name is dropped before, if the session still runs when Python ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    if table_name:
        atexit.register(lambda: spark.sparkContext._jsc and spark.sql(f"DROP TABLE IF EXISTS {table_name}"))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
