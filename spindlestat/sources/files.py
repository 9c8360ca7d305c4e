"""Reading measurements, and writing results."""

from __future__ import annotations

import html
import json
from collections.abc import Iterable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from ..functions.lineage import cut_lineage
from ..operators.errors import AnalysisError

ORDER = "_row"


def _place() -> Column:
    """Where a row of a file stands: the file, the place where the part begins that one task reads, and the row within."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None, with_order: bool = True) -> DataFrame:
    """CSV files with a header. Without a schema, types are inferred, which reads the files twice.

    with_order adds `_row`, which ascends in the order of the files: by path, by the place in it where the part begins
    that one task reads, and by the row within. Parts are packed into tasks by size, so the task alone tells nothing.
    """
    try:
        reader = spark.read.option("header", True)
        df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    except AnalysisException as e:
        raise AnalysisError("file_not_found" if "PATH_NOT_FOUND" in str(e) else "read_error", str(e).splitlines()[0]) from e
    except Py4JJavaError as e:  # what the file system itself refuses
        raise AnalysisError("read_error", str(e.java_exception)) from e
    if not df.columns:
        raise AnalysisError("empty_file", f"{path} is empty")
    if df.isEmpty():
        raise AnalysisError("no_data", f"{path} has no rows")
    return df.withColumn(ORDER, _place()) if with_order else df


def split_csv(spark: SparkSession, path: str, schema: StructType | None = None, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, corrupt) of CSV files: rows that fit the schema, with `_row` as in read_csv(), and the others.

    corrupt has file, start and row (as in `_row`) and record, the line as it stands. Lines are corrupt that have too few or
    too many fields, or a field that is none of its type. Both are lazy, and read the files once each.
    """
    if schema is None:
        schema = read_csv(spark, path, with_order=False).schema
    bad = "_corrupt"
    while bad in schema.names:
        bad = f"_{bad}"
    reader = spark.read.option("header", header).option("columnNameOfCorruptRecord", bad).option("mode", "PERMISSIVE").option("columnPruning", False)
    try:
        df = reader.schema(StructType([*schema.fields]).add(bad, "string")).csv(path).withColumn(ORDER, _place())
    except AnalysisException as e:
        raise AnalysisError("file_not_found" if "PATH_NOT_FOUND" in str(e) else "read_error", str(e).splitlines()[0]) from e
    # every field is looked at: the reader tells corrupt lines by the columns that a query needs, which Spark cuts down
    whole = F.size(F.array(*[F.col(f"`{c}`").cast("string") for c in schema.names])) == len(schema.names)
    return df.filter(F.col(bad).isNull() & whole).drop(bad), df.filter(F.col(bad).isNotNull() & whole).select(f"{ORDER}.*", F.col(bad).alias("record"))


def strict_csv(spark: SparkSession, path: str, schema: StructType | None = None, header: bool = True) -> DataFrame:
    """The rows of split_csv(); fails if a line is corrupt, and shows the first ones."""
    rows, corrupt = split_csv(spark, path, schema, header)
    first = corrupt.orderBy("file", "start", "row").limit(11).collect()
    if first:
        raise AnalysisError("corrupt_rows", f"{path} has lines that don't fit its columns", [f"{r['file']}: {r['record']}" for r in first[:10]] + ["and more"] * (len(first) > 10))
    return rows


def from_rows(spark: SparkSession, rows: Iterable, columns: Sequence[str] | StructType) -> DataFrame:
    """Rows from memory, numbered by `_row`."""
    rows = [tuple(r) if isinstance(r, (list, tuple)) else (r,) for r in rows]
    if not rows:
        raise AnalysisError("no_data", "no rows")
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], StructType([*columns.fields]).add(ORDER, "long") if isinstance(columns, StructType) else [*columns, ORDER])


def measured(df: DataFrame, *columns: str) -> DataFrame:
    """The columns as doubles: NaN becomes null, text that is no number too."""
    for c in columns:
        x = F.col(c).try_cast(DoubleType())
        df = df.withColumn(c, F.when(~F.isnan(x), x))
    return df


def as_json(df: DataFrame) -> DataFrame:
    """One column, json: each row as a JSON object. NaN and infinity, which JSON lacks, become null."""
    plain = [F.when(~F.isnan(f.name) & (F.abs(f.name) != float("inf")), F.col(f.name)).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*plain), {"ignoreNullFields": "false"}).alias("json"))


def shown(df: DataFrame, most: int | None) -> tuple[list[dict], int]:
    """The rows as plain objects, at most `most` of them (None: all), and how many there are."""
    rows = as_json(df)
    got = [json.loads(r.json) for r in (rows if most is None else rows.limit(most + 1)).collect()]
    return got[:most], len(got) if most is None or len(got) <= most else df.count()


def html_report(title: str, tables: dict[str, DataFrame], most: int | None = 200) -> str:
    """A small HTML page of result tables. Where a table has more than `most` rows (None: all are shown), the page says how many it has and that they are not all here; the frames have them."""
    out = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        rows, n = shown(df, most)
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape('' if r.get(c) is None else str(r[c]))}</td>" for c in df.columns) + "</tr>" for r in rows)
        note = f"<p>{len(rows)} of {n} rows</p>" if len(rows) < n else ""
        out.append(f"<h2>{html.escape(name)}</h2>{note}<table><tr>{head}</tr>{body}</table>")
    return "".join([*out, "</body></html>"])


def write_json(df: DataFrame, path: str) -> None:
    """The rows as JSON lines in a folder of files, which tasks write."""
    as_json(df).write.text(path)


def _cell(c: str) -> Column:
    x = F.coalesce(F.col(c).cast("string"), F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(sign), F.lit(name))
    return F.concat(F.lit("<td>"), x, F.lit("</td>"))


def group_pages(title: str, tables: dict[str, DataFrame], groups: Sequence[str], most: int = 200) -> DataFrame:
    """groups, page: an HTML page for each group, with `most` rows at most of each table, and how many it has in all.

    Built by tasks: of each table, a task keeps `most` rows of a group before any travel, in the order of their columns.
    """
    parts = []
    for number, (name, df) in enumerate(tables.items()):
        shown_cols = [c for c in df.columns if c not in groups]
        row = F.concat(F.lit("<tr>"), *[_cell(c) for c in shown_cols], F.lit("</tr>"))
        rows = df.dropna(subset=list(groups)).select(*groups, row.alias("row"))
        totals = rows.groupBy(*groups).count()
        ranked = rows.withColumn("i", F.row_number().over(Window.partitionBy(*groups).orderBy("row"))).filter(F.col("i") <= most)
        held = ranked.groupBy(*groups).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "row"))), lambda x: x["row"]), "").alias("rows"), F.max("i").alias("shown"))
        note = F.when(F.col("shown") < F.col("count"), F.concat(F.lit("<p>"), F.col("shown").cast("string"), F.lit(" of "), F.col("count").cast("string"), F.lit(" rows</p>"))).otherwise("")
        head = f"<h2>{html.escape(name)}</h2>", "<table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in shown_cols) + "</tr>"
        section = F.concat(F.lit(head[0]), note, F.lit(head[1]), "rows", F.lit("</table>"))
        parts.append(held.join(totals, list(groups)).select(*groups, F.struct(F.lit(number).alias("number"), section.alias("section")).alias("s")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    top = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"
    names = F.concat(*[x for g in groups for x in (F.lit(f"<p>{html.escape(g)}: "), F.regexp_replace(_cell(g), "</?td>", ""), F.lit("</p>"))])
    page = F.concat(F.lit(top), names, F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["section"]), ""), F.lit("</body></html>"))
    return every.groupBy(*groups).agg(page.alias("page"))


def write_group_pages(title: str, tables: dict[str, DataFrame], groups: Sequence[str], path: str, most: int = 200) -> None:
    """A page for each group in a folder of its own (path/pages/group=.../), and path/index, JSON lines with the groups and the size of their pages. All are written by tasks; nothing is collected."""
    pages = cut_lineage(group_pages(title, tables, groups, most).repartition(*groups))
    pages.write.partitionBy(*groups).text(f"{path}/pages")
    as_json(pages.select(*groups, F.length("page").alias("length"))).write.text(f"{path}/index")


def to_dict(df: DataFrame) -> list[dict]:
    """All rows of a result as plain objects; for results that are known to be few. shown() says when it leaves rows out."""
    return shown(df, None)[0]
