"""What a warehouse holds: schema and summary documents, dashboard statistics.

All categorical columns of a table are counted in one grouping over (column, value) pairs, all
numeric ones profiled from counts of their values; only top values and a row of statistics for each
column reach the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medloom.functions.names import on_dashboard
from medloom.operators.distribution import counted, interpolated, places
from medloom.operators.privacy import suppress_count
from medloom.session import settled
from medloom.sources.files import write_text

TOP = 15
DASHBOARD_COLUMNS = 4
_SQL_NAMES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
_NUMERIC = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType)


def visible(rows: DataFrame, forbidden: Iterable[str]) -> list[T.StructField]:
    hidden = {f.lower() for f in forbidden}
    return [f for f in rows.schema if f.name.lower() not in hidden]


def sql_type(kind: T.DataType) -> str:
    return _SQL_NAMES.get(kind.simpleString(), kind.simpleString().upper())


def value_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, n) for all the columns at once, nulls left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]))
    return rows.select(pairs.alias("_p")).select("_p.*").where("value IS NOT NULL").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def top_values(rows: DataFrame, columns: list[str], limit: int = TOP) -> DataFrame:
    """The most frequent values of each column, ties by value."""
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc("value"))
    return value_counts(rows, columns).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def numeric_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n, min, max, mean, median, q1, q3), rounded to two places.

    Quantiles are exact and no task holds a column's values (``distribution.places``).
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("no"), F.col(f"`{c}`").cast("double").alias("x")) for k, c in enumerate(columns)]))
    counts = settled(counted(rows.select(pairs.alias("p")).select("p.*"), ["no"], F.col("x")))
    # whole-column figures from the same counts: one row for each column
    figures = counts.groupBy("k.no").agg(F.sum("n").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean"))
    value = interpolated(F.col("low"), F.col("high"), F.col("between"))
    by_column = places(counts, [0.25, 0.5, 0.75]).groupBy("k.no").agg(*[F.max(F.when(F.col("q") == q, value)).alias(name) for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])
    names = rows.sparkSession.createDataFrame(list(enumerate(columns)), "no int, column_name string")
    every = names.join(F.broadcast(figures), "no", "left").join(F.broadcast(by_column), "no", "left")
    return every.select("column_name", F.coalesce("n", F.lit(0)).alias("n"), *[F.round(c, 2).alias(c) for c in ("min", "max", "mean", "median", "q1", "q3")])


#: Text columns with longer values are free text: their values are not listed.
LONGEST = 256


def text_columns(rows: DataFrame, columns: list[str]) -> list[str]:
    """Of text columns those with values, none of them longer than ``LONGEST``: one pass over all columns."""
    if not columns:
        return []
    seen = rows.agg(*[F.max(F.length(f"`{c}`")).alias(f"m{k}") for k, c in enumerate(columns)]).first()
    return [c for k, c in enumerate(columns) if seen[k] is not None and seen[k] <= LONGEST]


def _strings(rows: DataFrame, forbidden: Iterable[str]) -> list[str]:
    return [f.name for f in visible(rows, forbidden) if isinstance(f.dataType, T.StringType)]


def schema_document(tables: Mapping[str, DataFrame], project: str = "Dataset", forbidden: Iterable[str] = ("record_id",)) -> str:
    lines = [f"# {project} Schema", ""]
    for name in sorted(tables):
        fields = visible(tables[name], forbidden)
        lines += [f"## Table: `{name}`", "", f"- **Rows**: {tables[name].count()}", f"- **Columns**: {len(fields)}", "", "| Column | Type | Nullable |", "|--------|------|----------|"]
        lines += [f"| `{f.name}` | {sql_type(f.dataType)} | {'YES' if f.nullable else 'NO'} |" for f in fields] + [""]
    return "\n".join(lines)


def summary_document(tables: Mapping[str, DataFrame], project: str = "Dataset", forbidden: Iterable[str] = ("record_id",), k: int = 10) -> str:
    lines = [f"# {project} Summary Statistics", ""]
    for name in sorted(tables):
        rows = tables[name]
        fields = visible(rows, forbidden)
        lines += [f"## Table: `{name}` ({rows.count()} rows)", ""]
        texts = text_columns(rows, _strings(rows, forbidden))
        numbers = [f.name for f in fields if isinstance(f.dataType, _NUMERIC)]
        tops: dict[str, list] = {}
        for r in top_values(rows, texts).withColumn("shown", suppress_count(F.col("n"), k)).orderBy("column_name", "rank").collect() if texts else []:
            tops.setdefault(r.column_name, []).append(r)
        profiles = {r.column_name: r for r in numeric_profile(rows, numbers).collect()} if numbers else {}
        for f in fields:
            if isinstance(f.dataType, T.StringType) and f.name not in tops:
                lines += [f"### `{f.name}`", "", "- free text or empty; no values listed", ""]
            elif f.name in tops:
                lines += [f"### `{f.name}`", ""] + [f"- {r.value}: {r.shown}" for r in tops[f.name]] + [""]
            elif f.name in profiles and (p := profiles[f.name]).n:
                lines += [f"### `{f.name}`", "", f"- non-missing: {p.n if p.n >= k else f'<{k}'}", f"- range: {p.min:.2f} to {p.max:.2f}", f"- mean: {p.mean:.2f}", f"- median: {p.median:.2f} (quartiles {p.q1:.2f}, {p.q3:.2f})", ""]
    return "\n".join(lines)


def _shown(value: str, n: int, k: int) -> dict[str, Any]:
    return {"label": value, "n": n if n >= k else None, "suppressed": n < k}


def dashboard(tables: Mapping[str, DataFrame], project: str = "Dataset", forbidden: Iterable[str] = ("record_id",), k: int = 10) -> dict[str, Any]:
    """Project, tables, demographics and a few categorical columns per table, for a dashboard."""
    out: dict[str, Any] = {"project_name": project, "total_patients": None, "tables": [], "demographics": {}, "table_summaries": {}}
    for name in sorted(tables):
        rows = tables[name]
        fields = visible(rows, forbidden)
        n = rows.count()
        out["tables"].append({"name": name, "row_count": n, "column_count": len(fields), "column_names": [f.name for f in fields]})
        texts = text_columns(rows, _strings(rows, forbidden))
        chosen = [c for c in texts if on_dashboard(c)][:DASHBOARD_COLUMNS]
        demographics = [c for c in ("sex", "race", "ethnicity") if c in texts] if name == "cohort" else []
        texts = list(dict.fromkeys(chosen + demographics))
        tops: dict[str, list] = {}
        for r in top_values(rows, texts).orderBy("column_name", "rank").collect() if texts else []:
            tops.setdefault(r.column_name, []).append(_shown(r.value, r.n, k))
        if name == "cohort":
            out["total_patients"] = n
            out["demographics"] = {c: tops.get(c, []) for c in demographics}
        shown = [{"column": c, "values": tops[c]} for c in chosen if c in tops]
        if shown:
            out["table_summaries"][name] = {"categorical": shown}
    return out


def write_documents(tables: Mapping[str, DataFrame], folder: str, project: str, forbidden: Iterable[str] = ("record_id",), k: int = 10) -> None:
    spark = next(iter(tables.values())).sparkSession if tables else SparkSession.active()
    for name, text in (("schema.md", schema_document(tables, project, forbidden)), ("summary.md", summary_document(tables, project, forbidden, k)), ("summary_stats.json", json.dumps(dashboard(tables, project, forbidden, k), indent=2))):
        write_text(spark, f"{folder.rstrip('/')}/{name}", text)
