"""Dates from text, spans in years, and note-date names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tried in this order on each value.
FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "MM/dd/yyyy", "yyyyMMdd", "yyyy-MM")
_SHAPES = {
    "yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}$",
    "yyyy-MM-dd HH:mm:ss": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$",
    "yyyy-MM-dd'T'HH:mm:ss": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$",
    "MM/dd/yyyy": r"^\d{2}/\d{2}/\d{4}$",
    "yyyyMMdd": r"^\d{8}$",
    "yyyy-MM": r"^\d{4}-\d{2}$",
    "yyyy": r"^\d{4}$",
}
#: Other names of a note's date column, in order of preference.
DATE_ALIASES = ("note_date", "date", "service_date", "encounter_date", "date_of_service", "note_datetime", "datetime", "report_date", "document_date")

MICROS_PER_DAY = 86_400_000_000
DAYS_PER_YEAR = 365.25


def parse_text(value: Column, bare_year: bool = False, pinned: str | None = None) -> Column:
    """A timestamp from the first format that fits a text, else null."""
    text = F.trim(value)
    formats = (pinned,) if pinned else (*FORMATS, "yyyy") if bare_year else FORMATS
    return F.coalesce(*[F.when(text.rlike(_SHAPES[f]), F.try_to_timestamp(text, F.lit(f))) if f in _SHAPES else F.try_to_timestamp(text, F.lit(f)) for f in formats])


def parse_date(value: Column, kind: T.DataType, bare_year: bool = False) -> Column:
    """A timestamp from a text, date or timestamp column; null where none can be read."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return value.cast("timestamp")
    return parse_text(value.cast("string"), bare_year)


def years_between(start: Column, end: Column) -> Column:
    """Fractional years, to the microsecond."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(float(MICROS_PER_DAY)) / F.lit(DAYS_PER_YEAR)


def whole_days_in_years(start: Column, end: Column) -> Column:
    """Whole days between two times, floored, in years."""
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / F.lit(float(MICROS_PER_DAY))).cast("double") / F.lit(DAYS_PER_YEAR)


def is_blank(value: Column) -> Column:
    return value.isNull() | (F.trim(value.cast("string")) == "")


def find_date_column(columns: list[str], wanted: str) -> str | None:
    """The wanted column, or else the first alias that is there in any case."""
    if wanted in columns:
        return wanted
    lower = {c.lower(): c for c in columns}
    return next((lower[a] for a in DATE_ALIASES if a in lower), None)
