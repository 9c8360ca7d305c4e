"""Which column plays which role, from a schema alone; no job runs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql.types import NumericType, StructType

from .errors import AnalysisError

# Parts of names that rule a column out, and that speak for it, in this order.
CHART_SKIP = ("id", "subgroup", "batch", "sample", "group", "lot", "serial", "number")
CHART_WANTED = ("measurement", "value", "measure", "data", "reading", "result", "defect", "count")
MSA_SKIP = ("id", "part", "operator", "trial", "batch", "sample", "group", "appraiser")
MEASURED = ("measurement", "value", "measure", "reading", "result", "data")
MSA_ROLES = {"part": ("part",), "operator": ("operator", "appraiser"), "trial": ("trial", "repeat"), "reference": ("reference", "standard", "master"), "date": ("date", "time")}


@dataclass(frozen=True)
class Roles:
    value: str | None = None
    subgroup: str | None = None
    date: str | None = None
    sample_size: str | None = None
    opportunity: str | None = None
    part: str | None = None
    operator: str | None = None
    trial: str | None = None
    reference: str | None = None

    def check(self, schema: StructType) -> Roles:
        """Itself, if every named column exists."""
        for f in fields(self):
            name = getattr(self, f.name)
            if name is not None and name not in schema.names:
                raise AnalysisError("column_not_found", f"{f.name}: no column {name}; there are {', '.join(schema.names)}")
        return self


def numeric_columns(schema: StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, NumericType)]


def pick(schema: StructType, skip: Sequence[str], wanted: Sequence[str]) -> str:
    """The numeric column whose name speaks most for it; the first one if none does."""
    numeric = numeric_columns(schema)
    if not numeric:
        raise AnalysisError("no_numeric_columns", "no numeric column")
    left = [c for c in numeric if not any(s in c.lower() for s in skip)] or numeric
    return next((c for w in wanted for c in left if w in c.lower()), left[0])


def chart_value(schema: StructType) -> str:
    return pick(schema, CHART_SKIP, CHART_WANTED)


def msa_value(schema: StructType, parity: bool = False) -> str:
    """parity: simply the first numeric column."""
    return pick(schema, (), ()) if parity else pick(schema, MSA_SKIP, MEASURED)


def capability_value(schema: StructType, parity: bool = False) -> str:
    return pick(schema, (), ()) if parity else pick(schema, CHART_SKIP, MEASURED)


def msa_roles(schema: StructType, given: Roles = Roles()) -> Roles:
    """The given roles, and the others by name."""
    found = {role: getattr(given, role) or next((c for c in schema.names if any(w in c.lower() for w in words)), None) for role, words in MSA_ROLES.items()}
    return Roles(**{f.name: found.get(f.name) or getattr(given, f.name) for f in fields(given)})
