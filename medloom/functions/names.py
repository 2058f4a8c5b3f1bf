"""Rules about names: PII columns, tables from categories, counts and rates. Plain functions on the driver."""

from __future__ import annotations

import re
from collections.abc import Iterable

# Fixed values.
PII_NAMES = frozenset({"last_nm", "first_nm", "middle_nm", "last_name", "first_name", "middle_name", "patient_name", "full_name"})
PII_PARTS = ("mrn", "ssn")
COUNT_NAMES = frozenset({"count", "cnt", "n", "total", "freq", "frequency"})
COUNT_STARTS = ("n_", "num_", "count_", "cnt_")
COUNT_ENDS = ("_count", "_cnt", "_total", "_n", "_freq")
NOT_COUNTS = frozenset({"n_stage", "m_stage", "t_stage", "total_dose", "total_fractions", "n_category"})
RATE_PARTS = ("pct", "percent", "rate", "prevalence", "proportion", "ci_lower", "ci_upper", "survival", "median_os")
OFF_DASHBOARD = ("date", "time", "timestamp", "calendar_year", "years_since_birth", "record_id", "patient_id", "id", "data_source")


def is_pii(name: str, id_columns: Iterable[str] = ()) -> bool:
    lower = name.lower()
    return lower in PII_NAMES or any(p in lower for p in PII_PARTS) or name in set(id_columns)


def table_name(category: str) -> str:
    """A table's name from a category: no ``cancer_``, no therapy endings, only letters, digits and underscores."""
    name = category.strip().lower().removeprefix("cancer_")
    for part in ("_therapy_regimen", "_therapy"):
        name = name.replace(part, "")
    return safe_name(name)


def safe_name(name: str) -> str:
    """A lower-case SQL identifier."""
    name = re.sub(r"[^a-z0-9_]", "_", name.strip().lower())
    if not name:
        return "unknown"
    return f"t_{name}" if name[0].isdigit() else name


def category_of(stem: str, known: Iterable[str]) -> str:
    """The category in a file's stem ``<source>_<category>``: the longest known one, else the last part."""
    fits = [k for k in known if stem == k or stem.endswith(f"_{k}")]
    return max(fits, key=len) if fits else stem.rpartition("_")[2]


def is_count(name: str) -> bool:
    name = name.lower().strip()
    return name not in NOT_COUNTS and (name in COUNT_NAMES or name.startswith(COUNT_STARTS) or name.endswith(COUNT_ENDS))


def is_rate(name: str) -> bool:
    lower = name.lower()
    return any(p in lower for p in RATE_PARTS)


def on_dashboard(name: str) -> bool:
    lower = name.lower()
    return not any(p in lower for p in OFF_DASHBOARD)


def count_columns(names: Iterable[str], explicit: Iterable[str] | None = None, planned: Iterable[str] = ()) -> list[str]:
    """Output columns that hold counts: those named in a request, or else by name or by the plan."""
    names = list(names)
    if explicit:
        asked = {c.lower().strip() for c in explicit}
        return [c for c in names if c.lower() in asked]
    from_plan = set(planned)
    return [c for c in names if c in from_plan or is_count(c)]
