"""Checks of the data before an analysis, and the choice of a chart: one aggregate over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

from ..functions.joins import gathered, settled, with_group
from ..functions.lineage import cut_lineage
from .common import grouped, ratio
from .errors import AnalysisError
from .roles import Roles

# Fixed values.
ERROR_CODES = (999.0, 9999.0, -999.0, -9999.0)
LEAST_ROWS = {"chart": 25, "capability": 30}
DISTINCT_SHARE, MOST_COUNT, MOST_CV, LEAST_PARTS, LEAST_OPERATORS = 0.3, 50, 1.0, 10, 2


def number(value: str) -> Column:
    x = F.col(value).try_cast(DoubleType())
    return F.when(~F.isnan(x), x)


def profile(df: DataFrame, value: str, groups: Sequence[str] = (), usl: float | None = None, lsl: float | None = None) -> DataFrame:
    """All counts and moments that checks and the chart choice need, of each group."""
    x = number(value)
    tests = row_tests(value, usl, lsl)
    one = lambda code: F.count_if(tests.get(code, F.lit(False)))
    return grouped(df, groups).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(x).alias("n"), one("missing_values").alias("n_missing"), one("non_numeric").alias("n_text"), one("error_codes").alias("n_codes"), one("negative_values").alias("n_negative"), one("mostly_outside").alias("n_outside"),
        F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.avg(x).alias("x_mean"), F.stddev_samp(x).alias("x_sd"), F.bool_and(x.isin(0.0, 1.0)).alias("binary"), F.bool_and(x == F.floor(x)).alias("whole"),
    )


def issues(df: DataFrame, value: str, kind: str = "chart", groups: Sequence[str] = (), usl: float | None = None, lsl: float | None = None) -> DataFrame:
    """severity, code, n of each finding. kind: chart, msa or capability, which differ in what is an error."""
    p = profile(df, value, groups, usl, lsl)
    error, warning = "ERROR", "WARNING"
    found = [(error if kind == "msa" else warning, "missing_values", F.col("n_missing"), F.col("n_missing") > 0)]
    n = F.col("n")
    if kind != "msa":
        found += [(error, "non_numeric", F.col("n_text"), F.col("n_text") > 0), (warning, "error_codes", F.col("n_codes"), F.col("n_codes") > 0), (warning, "negative_values", F.col("n_negative"), F.col("n_negative") > 0), (warning, "small_sample", n, n < LEAST_ROWS[kind])]
    found.append((warning if kind == "chart" else error, "no_variation", n, F.col("x_min") == F.col("x_max")))
    if kind == "chart":
        found.append((warning, "high_variation", n, F.coalesce(F.col("x_sd") / F.abs(F.when(F.col("x_mean") != 0, F.col("x_mean"))) > MOST_CV, F.lit(False))))
    if kind == "capability":
        found.append((warning, "mostly_outside", F.col("n_outside"), ratio(F.col("n_outside"), n, 0.0) > 0.5))
    rows = F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"), m.cast("long").alias("n"), F.coalesce(t, F.lit(False)).alias("holds")) for s, c, m, t in found])
    return p.select(*groups, rows.alias("r")).select(*groups, F.explode("r").alias("i")).filter("i.holds").select(*groups, "i.severity", "i.code", "i.n")


def row_tests(value: str, usl: float | None = None, lsl: float | None = None) -> dict[str, Column]:
    """For each code that single rows can be blamed for, whether a row is one of them."""
    x, raw = number(value), F.col(value)
    missing = raw.isNull() | F.coalesce(F.isnan(raw.try_cast(DoubleType())), F.lit(False))
    tests = {"missing_values": missing, "non_numeric": ~missing & x.isNull(), "error_codes": x.isin(*ERROR_CODES), "negative_values": x < 0}
    return tests | ({"mostly_outside": (x > usl) | (x < lsl)} if usl is not None and lsl is not None else {})


def first_rows(df: DataFrame, tests: dict[str, Column], order_cols: Sequence[str], groups: Sequence[str] = (), most: int = 10) -> DataFrame:
    """code, place (1 to `most`) and the columns of the first rows, in each group, for which each test holds: what a finding shows of its rows. This limit is the feature; Spark cuts each task's rows to it before the shuffle."""
    holds = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(c)) for c, t in tests.items()]))
    rows = df.select(F.explode(holds).alias("code"), *df.columns)
    w = Window.partitionBy("code", *groups).orderBy(*order_cols)
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def gage_issues(df: DataFrame, part: str | None, operator: str | None, groups: Sequence[str] = ()) -> DataFrame:
    """Checks of a gage study's design, by group: unequal cells, few parts, few operators."""
    if not part or not operator:
        raise AnalysisError("missing_columns", "a gage study needs a part and an operator")
    cells = grouped(df, [*groups, part, operator]).count()
    shape = grouped(cells, groups).agg(F.min("count").alias("least"), F.max("count").alias("most"), F.count_distinct(part).alias("parts"), F.count_distinct(operator).alias("operators"))
    found = [("unbalanced", F.col("most"), F.col("least") != F.col("most")), ("few_parts", F.col("parts"), F.col("parts") < LEAST_PARTS), ("few_operators", F.col("operators"), F.col("operators") < LEAST_OPERATORS)]
    rows = F.array(*[F.struct(F.lit("WARNING").alias("severity"), F.lit(c).alias("code"), n.cast("long").alias("n"), F.coalesce(t, F.lit(False)).alias("holds")) for c, n, t in found])
    return shape.select(*groups, F.explode(rows).alias("i")).filter("i.holds").select(*groups, "i.severity", "i.code", "i.n")


def missing_references(df: DataFrame, reference: str, groups: Sequence[str] = ()) -> DataFrame:
    n = grouped(df, groups).agg(F.sum(F.col(reference).isNull().cast("long")).alias("n")).filter("n > 0")
    return n.select(*groups, F.lit("ERROR").alias("severity"), F.lit("missing_references").alias("code"), "n")


def gate(found: DataFrame) -> None:
    """Raises if any finding is an error, with a line for each code: how many groups have it, and how many rows in all."""
    errors = found.filter("severity = 'ERROR'").groupBy("code").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n")).orderBy("code").collect()
    if errors:
        raise AnalysisError("data_quality_error", "the data have errors", [f"{r['code']}: {r['n']}" + (f" in {r['groups']} groups" if r["groups"] > 1 else "") for r in errors])


def route(df: DataFrame, found: DataFrame, groups: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine): the rows of groups without an error among their findings, and those of the others with `codes`, the errors. Rows with a null group are in neither."""
    codes = found.filter("severity = 'ERROR'").groupBy(*groups).agg(F.array_sort(F.collect_set("code")).alias("codes"))
    near = gathered(codes)
    bad = cut_lineage(codes) if near is None else F.broadcast(near)
    df = df.dropna(subset=list(groups))
    return df.join(bad, list(groups), "left_anti"), df.join(bad, list(groups))


def many_distinct(df: DataFrame, value: str, profiled: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """groups, many: whether more than DISTINCT_SHARE of the rows are distinct values, for groups of whole numbers that depend on it.

    Whole numbers can't have more distinct values than their range is wide, which decides most groups from the profile
    alone. For the others a mergeable sketch of the values is taken, and only where that comes within a fifth of the
    share (ten times its standard error) are the distinct values of the group counted, which shuffles them.
    """
    share = lambda n: ratio(n, F.col("n_rows"), 0.0)
    whole = profiled.filter(F.col("whole")).select(*groups, "n_rows", (F.col("x_max") - F.col("x_min") + 1).alias("width"))
    open_ = settled(whole.filter(share(F.col("width")) > DISTINCT_SHARE).select(*groups, "n_rows"))
    sure = whole.filter(share(F.col("width")) <= DISTINCT_SHARE).select(*groups, F.lit(False).alias("many"))
    if open_.isEmpty():
        return sure
    rows = with_group(df.select(*groups, number(value).alias("_x")), open_, groups)
    guessed = settled(grouped(rows, groups).agg(F.approx_count_distinct("_x", 0.02).alias("n"), F.first("n_rows").alias("n_rows")).withColumn("s", share(F.col("n"))))
    near = guessed.filter(F.abs(F.col("s") - DISTINCT_SHARE) <= 0.2 * DISTINCT_SHARE)
    out = sure.unionByName(guessed.filter(F.abs(F.col("s") - DISTINCT_SHARE) > 0.2 * DISTINCT_SHARE).select(*groups, (F.col("s") > DISTINCT_SHARE).alias("many")))
    if near.isEmpty():
        return out
    exact = grouped(with_group(rows, near.select(*groups, F.lit(True).alias("_near")), groups), groups).agg(F.count_distinct("_x").alias("n"), F.first("n_rows").alias("n_rows"))
    return out.unionByName(exact.select(*groups, (share(F.col("n")) > DISTINCT_SHARE).alias("many")))


def chart_choice(df: DataFrame, roles: Roles, groups: Sequence[str] = ()) -> DataFrame:
    """data_type, attribute_type, subgroup_size and chart of each group, from one pass (more with subgroups, and where many_distinct() needs them)."""
    p = settled(profile(df, roles.value, groups))
    many = many_distinct(df, roles.value, p, groups)
    p = p.join(many, list(groups), "left") if groups else p.join(F.broadcast(many), F.lit(True), "left")  # a row for each group on either side
    counted = roles.sample_size is not None or roles.opportunity is not None
    attribute = F.lit(counted) | F.coalesce("binary", F.lit(False))
    small_counts = F.col("whole") & (F.col("x_min") >= 0) & (F.col("x_max") < MOST_COUNT)
    data_type = F.when(attribute | small_counts, "attribute").when(~F.col("whole"), "continuous").when(F.col("many"), "continuous").otherwise("attribute")
    p = p.withColumn("data_type", data_type).withColumn("attribute_type", F.when(F.col("data_type") == "attribute", F.when(F.coalesce("binary", F.lit(False)) | F.lit(roles.sample_size is not None), "defectives").otherwise("defects")))
    extra = {}
    if roles.subgroup:
        sizes = grouped(df, [*groups, roles.subgroup]).count()
        s = grouped(sizes, groups).agg(F.min_by("count", roles.subgroup).alias("subgroup_size"), (F.min("count") != F.max("count")).alias("variable_subgroups"))
        p = p.join(s, list(groups)) if groups else p.crossJoin(F.broadcast(s))
    else:
        extra = {"subgroup_size": F.lit(1).cast("long"), "variable_subgroups": F.lit(False)}
    for role, name in ((roles.sample_size, "size_varies"), (roles.opportunity, "opportunity_varies")):
        if role:
            v = grouped(df, groups).agg((F.min(role) != F.max(role)).alias(name))
            p = p.join(v, list(groups)) if groups else p.crossJoin(F.broadcast(v))
        else:
            extra[name] = F.lit(False)
    p = p.withColumns(extra)
    size = F.col("subgroup_size")
    continuous = F.when(size == 1, "I-MR").when(size <= 9, "Xbar-R").otherwise("Xbar-S")
    chart = F.when(F.col("data_type") == "continuous", continuous).when(F.col("attribute_type") == "defectives", F.when(F.col("size_varies"), "P").otherwise("NP")).otherwise(F.when(F.col("opportunity_varies"), "U").otherwise("C"))
    return p.select(*groups, "data_type", "attribute_type", "subgroup_size", "variable_subgroups", chart.alias("chart"))
