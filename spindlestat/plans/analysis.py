"""Whole analyses of one data set, from a file or a DataFrame: detect roles, check the data, choose, compute, and report.

Each has two forms. chart_analysis, msa_analysis and capability_analysis return an Analysis, whose tables are lazy
DataFrames with every row, to be written or worked on. The columns they need of the input are read once for all of them, and
kept until close() (or the end of a with block). With quarantine, groups whose data have errors are set aside, and the
others go on. run_... are the same as plain objects for JSON: at most `most` rows
of a table, with `totals` of how many each has and `truncated`, the names of those that are not whole (most=None: all).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace
from functools import partial, reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.joins import settled
from ..operators import capability as cap, charts, msa as gauge, quality
from ..operators.errors import AnalysisError
from ..operators.roles import Roles, capability_value, chart_value, msa_roles, msa_value
from ..sources.files import ORDER, html_report, measured, read_csv, shown, write_group_pages, write_json

MOST = 10_000
#: What each kind of chart takes besides roles and order.
OPTIONS = {"P": ("parity",), "U": ("parity",), "Xbar-R": ("clip_lcl",), "Xbar-S": ("clip_lcl",)}


class Tables(Mapping):
    """Tables by name. One that is given as a function is made when it is first asked for, with what it needs to be computed for it."""

    def __init__(self, made: dict[str, DataFrame | Callable[[], DataFrame]]):
        self._made = dict(made)

    def __getitem__(self, name: str) -> DataFrame:
        if not isinstance(self._made[name], DataFrame):
            self._made[name] = self._made[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._made)

    def __len__(self) -> int:
        return len(self._made)


@dataclass
class Analysis:
    kind: str
    roles: Roles
    tables: Tables
    facts: dict = field(default_factory=dict)
    kept: DataFrame | None = None

    def __enter__(self) -> Analysis:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Frees the input that the tables share; they stay valid, but would read it anew."""
        if self.kept is not None:
            self.kept.unpersist()

    def write(self, path: str, groups: Sequence[str]) -> None:
        """Pages for each group, with an index, and every table as JSON lines, by tasks; for any number of groups."""
        write_group_pages(f"{self.kind} analysis", {name: df for name, df in self.tables.items() if set(groups) <= set(df.columns)}, groups, f"{path}/report")
        for name, df in self.tables.items():
            write_json(df, f"{path}/{name}")

    def as_dict(self, most: int | None = MOST) -> dict:
        got = {name: shown(df, most) for name, df in self.tables.items()}
        rows = {name: r for name, (r, _) in got.items()}
        return {"success": True, **self.facts, "roles": asdict(self.roles), **rows, "totals": {name: n for name, (_, n) in got.items()}, "truncated": [name for name, (r, n) in got.items() if len(r) < n]}

    def report(self, path: str, most: int | None = 200) -> str:
        """Writes an HTML page of the tables to `path` and returns it. Local: the page is small."""
        page = html_report(f"{self.kind} analysis", self.tables, most)
        with open(path, "w", encoding="utf-8") as f:
            f.write(page)
        return page


def _loaded(spark: SparkSession, data: str | DataFrame) -> DataFrame:
    """With `_row`, the order of rows. A DataFrame that lacks it is taken in the order of its partitions; give a date role where that means nothing."""
    if isinstance(data, str):
        return read_csv(spark, data)
    if data.isEmpty():
        raise AnalysisError("no_data", "no rows")
    return data if ORDER in data.columns else data.withColumn(ORDER, F.monotonically_increasing_id())


def _kept(df: DataFrame, roles: Roles, groups: Sequence[str]) -> DataFrame:
    """The columns that the analysis works on, read once for all of its tables: in memory, and on executors' disks where that is full. What an executor loses is read again."""
    named = [c for c in asdict(roles).values() if c]
    return df.select(*dict.fromkeys([*groups, ORDER, *named])).persist(StorageLevel.MEMORY_AND_DISK)


def _value(df: DataFrame, given: str | None, find) -> str:
    schema = df.drop(ORDER).schema
    return given or find(schema)


def _tests(df: DataFrame, roles: Roles, kind: str, groups: Sequence[str], quarantine: bool, usl: float | None = None, lsl: float | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The rows to go on with; issues, and issue_rows: the first rows of each. An error among them raises; with quarantine, only if every group has one, and the rows of groups that have are the table `quarantine`."""
    issues = quality.issues(df, roles.value, kind, groups, usl, lsl)
    if kind == "msa":
        columns = [*groups, "severity", "code", "n"]
        if roles.part and roles.operator:
            issues = issues.select(columns).unionByName(quality.gage_issues(df, roles.part, roles.operator, groups).select(columns))
        if roles.reference:
            issues = issues.select(columns).unionByName(quality.missing_references(df, roles.reference, groups).select(columns))
    issues = settled(issues)
    more = {}
    if quarantine and groups:
        good, more["quarantine"] = quality.route(df, issues, groups)
        if good.isEmpty():
            quality.gate(issues)
    else:
        good = df
        quality.gate(issues)
    tests = quality.row_tests(roles.value, usl, lsl)
    rows = quality.first_rows(df.select(*groups, ORDER, roles.value), tests, [ORDER], groups)
    return good, {"issues": issues, "issue_rows": rows.join(issues.select(*groups, "code"), [*groups, "code"], "left_semi"), **more}


def _limits(result: charts.ChartResult, roles: Roles, groups: Sequence[str]) -> DataFrame:
    """The lines of a chart. P and U charts have others for each sample size or number of units."""
    lines = [c for c in ("ucl", "cl", "lcl", "mr_ucl", "mr_cl", "mr_lcl", "spread_ucl", "spread_cl", "spread_lcl") if c in result.points.columns]
    by = {"P": roles.sample_size, "U": roles.opportunity}.get(result.chart)
    if by:
        return result.points.select(*groups, F.col(by).alias("size"), *lines).distinct()
    return result.points.groupBy(*groups).agg(*[F.first(c, True).alias(c) for c in lines])


def _together(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def chart_analysis(spark: SparkSession, data: str | DataFrame, roles: Roles = Roles(), chart: str | None = None, group_cols: Sequence[str] = (), quarantine: bool = False, **options) -> Analysis:
    """limits, summary, violations (points, and spread_violations: ranges or deviations), choice and issues. Without a chart given, each group has its own choice; there is a plan for each kind of chart that is chosen, over the groups that chose it."""
    df = _loaded(spark, data)
    groups = list(group_cols)
    roles = replace(roles, value=_value(df, roles.value, chart_value)).check(df.schema)
    kept = _kept(df, roles, groups)
    df, found = _tests(kept, roles, "chart", groups, quarantine)
    df = measured(df, roles.value)
    choice = settled(quality.chart_choice(df, roles, groups))
    if chart:
        choice = choice.withColumn("chart", F.lit(chart))
    kinds = sorted(r["chart"] for r in choice.select("chart").distinct().collect())
    if unknown := set(options) - set().union(*OPTIONS.values()):
        raise TypeError(f"no option {', '.join(sorted(unknown))}")
    tables: dict[str, list[DataFrame]] = {}
    order = [roles.date] if roles.date else [ORDER]
    for kind in kinds:
        rows = df.join(choice.filter(F.col("chart") == kind).select(*groups), groups, "left_semi") if groups and len(kinds) > 1 else df
        result = charts.control_chart(rows, roles, kind, order, groups, **{k: v for k, v in options.items() if k in OPTIONS.get(kind, ())})
        spread = next((c for c in ("mr_reason", "spread_reason") if c in result.points.columns), None)
        frames = {"limits": _limits(result, roles, groups), "summary": result.summary, "violations": result.violations} | ({"spread_violations": result.points.filter(F.col(spread).isNotNull())} if spread else {})
        for name, frame in frames.items():
            tables.setdefault(name, []).append(frame.withColumn("chart", F.lit(kind)))
    facts = {"chart": kinds[0] if len(kinds) == 1 else None, "charts": kinds}
    return Analysis("Control chart", roles, Tables({**{name: _together(f) for name, f in tables.items()}, "choice": choice, **found}), facts, kept)


def msa_analysis(spark: SparkSession, data: str | DataFrame, roles: Roles = Roles(), study: str | None = None, method: str = "anova", tolerance: float | None = None, group_cols: Sequence[str] = (), quarantine: bool = False) -> Analysis:
    """result, what its plots show (points, or components and means) and issues."""
    df = _loaded(spark, data)
    groups = list(group_cols)
    roles = replace(msa_roles(df.drop(ORDER).schema, roles), value=_value(df, roles.value, msa_value)).check(df.schema)
    if roles.reference == roles.value:
        roles = replace(roles, reference=None)
    kept = _kept(df, roles, groups)
    df, found = _tests(kept, roles, "msa", groups, quarantine)
    df = measured(df, *[c for c in (roles.value, roles.reference) if c])
    chosen, result = gauge.msa(df, roles, study, method, tolerance, groups)
    plots: dict[str, Callable[[], DataFrame]] = {}
    if chosen == "gage_rr":
        for name, keys in (("by_part", [roles.part]), ("by_operator", [roles.operator]), ("interaction", [roles.part, roles.operator])):
            plots[name] = partial(gauge.means_by, df, roles.value, keys, groups)
        if method == "anova":
            plots["components"] = partial(gauge.gage_components, result, groups)
    elif chosen == "stability":
        plots["points"] = partial(gauge.stability_points, df, roles.value, [roles.date], groups)
    else:
        plots["points"] = partial(gauge.bias_points, df, roles.value, roles.reference, groups)
        if chosen == "linearity":
            plots["by_reference"] = partial(gauge.bias_by_reference, df, roles.value, roles.reference, groups)
    return Analysis("Measurement system", roles, Tables({"result": result, **plots, **found}), {"study": chosen, "method": method}, kept)


def capability_analysis(spark: SparkSession, data: str | DataFrame, usl: float, lsl: float, target: float | None = None, roles: Roles = Roles(), group_cols: Sequence[str] = (), quarantine: bool = False) -> Analysis:
    """capability, normality, the frames of the plots, and issues."""
    cap.check_limits(usl, lsl)
    df = _loaded(spark, data)
    groups = list(group_cols)
    roles = replace(roles, value=_value(df, roles.value, capability_value)).check(df.schema)
    kept = _kept(df, roles, groups)
    df, found = _tests(kept, roles, "capability", groups, quarantine, usl, lsl)
    df = measured(df, roles.value)
    value = roles.value
    plots = {name: partial(frame, df, value, groups) for name, frame in (("normality", cap.normality), ("histogram", cap.histogram), ("normal_curve", cap.normal_curve), ("box_plot", cap.box_plot), ("quantiles", cap.qq))}
    result = cap.capability(df, value, usl, lsl, target, roles.subgroup, groups)
    return Analysis("Capability", roles, Tables({"capability": result, **plots, **found}), {"usl": usl, "lsl": lsl}, kept)


def run_control_chart_analysis(spark: SparkSession, data: str | DataFrame, roles: Roles = Roles(), chart: str | None = None, group_cols: Sequence[str] = (), most: int | None = MOST, **options) -> dict:
    with chart_analysis(spark, data, roles, chart, group_cols, **options) as found:
        return found.as_dict(most)


def run_msa_analysis(spark: SparkSession, data: str | DataFrame, roles: Roles = Roles(), study: str | None = None, method: str = "anova", tolerance: float | None = None, group_cols: Sequence[str] = (), most: int | None = MOST, quarantine: bool = False) -> dict:
    with msa_analysis(spark, data, roles, study, method, tolerance, group_cols, quarantine) as found:
        return found.as_dict(most)


def run_capability_analysis(spark: SparkSession, data: str | DataFrame, usl: float, lsl: float, target: float | None = None, roles: Roles = Roles(), group_cols: Sequence[str] = (), most: int | None = MOST, quarantine: bool = False) -> dict:
    with capability_analysis(spark, data, usl, lsl, target, roles, group_cols, quarantine) as found:
        return found.as_dict(most)


def attempt(analysis, *args, **options) -> str:
    """The analysis as JSON text; its known failures too, with success false and their code."""
    try:
        return json.dumps(analysis(*args, **options))
    except AnalysisError as e:
        return json.dumps(e.as_dict())
