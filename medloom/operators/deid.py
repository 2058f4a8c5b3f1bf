"""De-identification of tables: ids, dates, personal columns, sparse columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medloom.functions.dates import parse_date, parse_text, whole_days_in_years
from medloom.functions.names import is_pii

#: Columns that are never read as dates.
NOT_DATES = ("record_id", "category", "source", "birth_date", "data_source")
DERIVED = ("_years_since_birth", "_calendar_year")


def strip_pii(rows: DataFrame, id_columns: Iterable[str] = ()) -> DataFrame:
    return rows.drop(*[c for c in rows.columns if is_pii(c, id_columns)])


def rename_id(rows: DataFrame, id_columns: Iterable[str], to: str = "record_id") -> DataFrame:
    """The first configured id column (by name) becomes ``to``, unless it is there."""
    if to in rows.columns:
        return rows
    found = next((c for c in sorted(id_columns) if c in rows.columns), None)
    return rows.withColumnRenamed(found, to) if found else rows


def replace_ids(rows: DataFrame, ids: DataFrame, key: str = "record_id") -> DataFrame:
    """Original ids to de-identified ones; rows without one stay, with a null id.

    ``ids`` holds (patient_id, record_id); it grows with the cohort, so Spark chooses the join.
    """
    names = ids.select(F.col("patient_id").cast("string").alias("_pid"), F.col("record_id").alias("_rid"))
    joined = rows.join(names, F.col(key).cast("string") == F.col("_pid"), "left")
    return joined.select(*[F.col("_rid").alias(key) if c == key else F.col(f"`{c}`") for c in rows.columns])


def date_columns(rows: DataFrame) -> list[str]:
    """Date columns by type, and text columns of which more than half of the values parse (one pass for all).

    Bare years count only where the name speaks of a date or year.
    """
    names = [c for c in rows.columns if c not in NOT_DATES and not c.endswith(DERIVED)]
    typed = [c for c in names if isinstance(rows.schema[c].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]
    texts = [c for c in names if isinstance(rows.schema[c].dataType, T.StringType)]
    if texts:
        seen = rows.agg(*[x for k, c in enumerate(texts) for x in (F.count(F.col(f"`{c}`")).alias(f"n{k}"), F.count(parse_text(F.col(f"`{c}`"), _years(c))).alias(f"d{k}"))]).first()
        typed += [c for k, c in enumerate(texts) if seen[f"n{k}"] and seen[f"d{k}"] / seen[f"n{k}"] > 0.5]
    return [c for c in rows.columns if c in typed]


def _years(name: str) -> bool:
    return "date" in name.lower() or "year" in name.lower()


def shift_dates(rows: DataFrame, births: DataFrame | None, key: str = "record_id", columns: list[str] | None = None) -> DataFrame:
    """Each date column becomes whole days since birth in years, and its calendar year.

    Without birth dates the years since birth are null; raw dates never stay.
    """
    columns = date_columns(rows) if columns is None else columns
    if not columns:
        return rows
    if births is not None:
        born = births.select(F.col(key).alias("_bid"), F.col("birth_date").cast("timestamp").alias("_born"))
        rows = rows.join(born, F.col(key) == F.col("_bid"), "left").drop("_bid")
    else:
        rows = rows.withColumn("_born", F.lit(None).cast("timestamp"))
    out = []
    for c in rows.columns:
        if c == "_born":
            continue
        if c not in columns:
            out.append(F.col(f"`{c}`"))
            continue
        when = parse_date(F.col(f"`{c}`"), rows.schema[c].dataType, _years(c))
        out += [whole_days_in_years(F.col("_born"), when).alias(f"{c}_years_since_birth"), F.year(when).cast("long").alias(f"{c}_calendar_year")]
    return rows.select(*out)


def non_missing_counts(rows: DataFrame) -> DataFrame:
    """(column, n): non-null values of every column, in one pass."""
    counts = rows.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{k}") for k, c in enumerate(rows.columns)])
    pairs = ", ".join(f"'{c}', n{k}" for k, c in enumerate(rows.columns))
    return counts.select(F.expr(f"stack({len(rows.columns)}, {pairs}) AS (column_name, n)"))


def keep_filled_columns(rows: DataFrame, least: int = 10, key: str = "record_id") -> DataFrame:
    """Columns with at least so many values; the key always stays."""
    seen = {r.column_name: r.n for r in non_missing_counts(rows).collect()}  # a row per column
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c == key or seen[c] >= least])
