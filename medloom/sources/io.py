"""Reading files: formats, null tokens, schema peeks, and where inputs are found."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medloom.sources import files

#: What a CSV reader takes for missing.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def _csv(spark: SparkSession, path: str, header: bool) -> DataFrame:
    """The file as strings.  Only where a line holds an odd number of quotes may values contain line ends;
    then a file is one task, else it is split."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    broken = spark.read.text(path).where(quotes % 2 == 1).limit(1).count() > 0
    return spark.read.csv(path, header=header, multiLine=broken, escape='"', quote='"')


def read_csv(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """A CSV file with header; null tokens become null, then each column takes the narrowest type all its values fit."""
    text = _csv(spark, path, True)
    clean = text.select(*[F.when(~F.col(f"`{c}`").isin(*NA_TOKENS), F.col(f"`{c}`")).alias(c) for c in text.columns])
    return infer_types(clean) if infer else clean


def infer_types(rows: DataFrame) -> DataFrame:
    """String columns as bigint, double or boolean where every value can be read so: one pass for all columns."""
    names = [f.name for f in rows.schema if isinstance(f.dataType, T.StringType)]
    if not names:
        return rows
    tests = []
    for k, c in enumerate(names):
        v = F.trim(F.col(f"`{c}`"))
        some = F.count(v)
        tests += [some.alias(f"n{k}"), F.count(v.try_cast("bigint")).alias(f"l{k}"), F.count(v.try_cast("double")).alias(f"d{k}"), F.count(F.when(F.lower(v).isin("true", "false"), 1)).alias(f"b{k}")]
    seen = rows.agg(*tests).first()

    def typed(k: int, c: str):
        v, n = F.trim(F.col(f"`{c}`")), seen[f"n{k}"]
        for kind, key in (("bigint", "l"), ("double", "d"), ("boolean", "b")):
            if n and seen[f"{key}{k}"] == n:
                return v.try_cast(kind).alias(c)
        return F.col(f"`{c}`")

    at = {c: k for k, c in enumerate(names)}
    return rows.select(*[typed(at[c], c) if c in at else F.col(f"`{c}`") for c in rows.columns])


def _header(spark: SparkSession, path: str) -> list[str]:
    """A CSV file's header as it stands: readers rename columns that clash."""
    line = spark.read.text(path).first()
    if line is None:
        return []
    whole = line.value.count('"') % 2 == 1  # a name goes on in the next line
    first = spark.read.csv(path, header=False, multiLine=whole, escape='"').first()
    return [c for c in first or () if c is not None]


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """Parquet by its ending, anything else as CSV; columns that differ only in case are refused."""
    names = columns_of(spark, path)
    lower = [c.lower() for c in names]
    if len(set(lower)) < len(lower):
        raise ValueError(f"{path}: columns differ only in case: {sorted(c for c in names if lower.count(c.lower()) > 1)}")
    return spark.read.parquet(path) if path.endswith(".parquet") else read_csv(spark, path)


def columns_of(spark: SparkSession, path: str) -> list[str]:
    """The column names alone: a parquet footer or a CSV header."""
    return spark.read.parquet(path).columns if path.endswith(".parquet") else _header(spark, path)


def resolve_files(spark: SparkSession, paths: Iterable[str], extensions: Sequence[str] = (".csv", ".parquet")) -> list[str]:
    """Files, and the files right inside folders, with these endings; each once, by name."""
    found: dict[str, str] = {}
    for p in paths:
        inside = files.is_folder(spark, p) and files.suffix_of(p) not in extensions  # a parquet table is a folder, too
        for f in files.listed(spark, p) if inside else [p]:
            if files.suffix_of(f) in extensions and files.exists(spark, f):
                found.setdefault(files.full_name(spark, f), f)
    return sorted(found.values(), key=files.name_of)


def find_file(spark: SparkSession, name: str, paths: Iterable[str]) -> str | None:
    """A full path, a file in an input folder, or an input file of that name."""
    if name.startswith("/") or "://" in name:
        return name if files.exists(spark, name) else None
    for p in paths:
        inside = f"{p.rstrip('/')}/{name}"
        if files.exists(spark, inside):
            return inside
        if files.name_of(p) == name and files.exists(spark, p):
            return p
    return None


def first_existing(spark: SparkSession, folder: str, names: Sequence[str], paths: Iterable[str] = ()) -> str | None:
    """The first of the names in a folder, else among the inputs."""
    paths, own = list(paths), [f"{folder.rstrip('/')}/{n}" for n in names]
    return next((f for f in own if files.exists(spark, f)), None) or next((f for n in names if (f := find_file(spark, n, paths))), None)


def detect_patient_file(spark: SparkSession, inputs: Iterable[str], pid: str) -> str | None:
    return next((f for f in inputs if pid in columns_of(spark, f)), None)


def id_column_of(path: str, by_file: Mapping[str, str], default: str) -> str:
    """A file's id column: by its name, by its stem, or the default."""
    if (name := files.name_of(path)) in by_file:
        return by_file[name]
    return next((c for f, c in by_file.items() if files.stem_of(f) == files.stem_of(path)), default)


def files_with_mapped_columns(spark: SparkSession, inputs: Iterable[str], mapped: set[str]) -> list[str]:
    return [f for f in inputs if mapped & set(columns_of(spark, f))]


def write_ids(ids: DataFrame, folder: str) -> None:
    """The cohort's original ids as a table, and as a JSON list for other tools."""
    ids.write.mode("overwrite").parquet(f"{folder}/cohort_ids.parquet")
    rows = (json.dumps(r[0]) for r in ids.select(ids.columns[0]).toLocalIterator())
    parts = (f"{', ' if k else ''}{x}" for k, x in enumerate(rows))
    files.write_text(ids.sparkSession, f"{folder}/cohort_ids.json", chain(["["], parts, ["]"]))
