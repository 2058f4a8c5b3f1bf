"""Structured sources into ontology categories: declared mappings, value maps, transforms."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from itertools import chain
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medloom.functions.dates import parse_date

log = logging.getLogger(__name__)

#: Larger value maps are joined instead of written into the expression.
MAP_IN_EXPRESSION = 500


@dataclass(frozen=True)
class FieldMapping:
    source: str
    target: str
    category: str
    transform: str | None = None
    value_map: Mapping[Any, Any] | None = None


def mappings_from_config(config: Mapping[str, Any]) -> list[FieldMapping]:
    """``{category: [{source, target, transform?, value_map?}]}``; categories without a list are skipped."""
    return [FieldMapping(x["source"], x["target"], category, x.get("transform"), x.get("value_map")) for category, items in config.items() if isinstance(items, list) for x in items]


def as_texts(table: Mapping[Any, Any]) -> dict[str, str]:
    """A value map with string keys and values; of keys that read alike the last counts."""
    return {str(a): str(b) for a, b in table.items()}


def map_values(value: Column, table: Mapping[Any, Any]) -> Column:
    """Mapped values as strings; values without an entry pass."""
    if not table:
        return value
    text = value.cast("string")
    pairs = F.create_map(*[F.lit(x) for x in chain(*as_texts(table).items())])
    return F.coalesce(F.element_at(pairs, text), text)


def transform(value: Column, name: str | None, kind: T.DataType) -> Column:
    """A named transform; nulls stay null; unknown names pass with a warning."""
    text = value.cast("string")
    match name:
        case None | "":
            return value
        case "lowercase":
            return F.lower(text)
        case "uppercase":
            return F.upper(text)
        case "strip":
            return F.trim(text)
        case "to_string":
            return text
        case "date_to_yyyy_mm_dd":
            return F.date_format(parse_date(value, kind, bare_year=True), "yyyy-MM-dd")
        case "to_numeric":
            return F.trim(text).try_cast("double")
    log.warning("unknown transform %s", name)
    return value


def mapped_columns(mappings: Iterable[FieldMapping], columns: Iterable[str]) -> set[str]:
    """The mapped columns that a source has: none, and the file need not be read."""
    return {m.source for m in mappings} & set(columns)


def harmonize(source: DataFrame, mappings: Iterable[FieldMapping], pid: str = "record_id") -> dict[str, DataFrame]:
    """A table per category with patient id, ``source`` and the target fields; categories without columns are skipped."""
    by_category: dict[str, list[FieldMapping]] = {}
    for m in mappings:
        if m.source in source.columns:
            by_category.setdefault(m.category, []).append(m)
    out = {}
    for category, fields in by_category.items():
        rows, columns = source, {}
        for m in fields:
            value, kind = F.col(f"`{m.source}`"), source.schema[m.source].dataType
            if m.value_map:
                if len(as_texts(m.value_map)) > MAP_IN_EXPRESSION:
                    # a configured table, not data: its size is bound by the configuration file
                    spark, no = source.sparkSession, len(columns)
                    table = spark.createDataFrame(list(as_texts(m.value_map).items()), f"_k{no} string, _v{no} string")
                    rows = rows.join(F.broadcast(table), value.cast("string") == F.col(f"_k{no}"), "left")
                    value = F.coalesce(F.col(f"_v{no}"), value.cast("string"))
                else:
                    value = map_values(value, m.value_map)
                kind = T.StringType()
            columns[m.target] = transform(value, m.transform, kind)
        out[category] = rows.select(F.col(f"`{pid}`").cast("string").alias(pid), F.lit("structured").alias("source"), *[c.alias(t) for t, c in columns.items() if t not in (pid, "source")])
    return out


def describe(mappings: Iterable[FieldMapping]) -> str:
    """The mappings as a table in Markdown, by category and target."""
    rows = sorted((m.category, m.target, m.source, m.transform or "", len(m.value_map or {})) for m in mappings)
    head = ["| category | field | column | transform | mapped values |", "|---|---|---|---|---|"]
    return "\n".join(head + [f"| {' | '.join(map(str, r))} |" for r in rows])
