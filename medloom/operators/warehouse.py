"""The published tables: approved categories only, aligned unions, written in one go."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medloom.functions.names import table_name
from medloom.operators.cohort import COHORT_COLUMNS
from medloom.operators.deid import keep_filled_columns, rename_id, replace_ids, shift_dates, strip_pii
from medloom.sources.files import current, is_folder, listed, name_of, published

COHORT = "cohort"


def union_aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both under the union of their columns; columns whose types differ become strings."""
    kinds = {f.name: f.dataType for f in right.schema}
    differ = [f.name for f in left.schema if f.name in kinds and f.dataType != kinds[f.name]]
    as_text = lambda df: df.withColumns({c: F.col(f"`{c}`").cast("string") for c in differ}) if differ else df
    return as_text(left).unionByName(as_text(right), allowMissingColumns=True)


def cohort_table(cohort: DataFrame) -> DataFrame:
    """The allowed cohort columns without the birth date."""
    return cohort.select(*[c for c in cohort.columns if c in COHORT_COLUMNS and c != "birth_date"])


def distinct_ids(sources: Iterable[DataFrame], columns: Iterable[str]) -> DataFrame:
    """Every id in any source, as strings: who is in when no cohort was defined."""
    names = list(columns)
    found = None
    for rows in sources:
        column = next((c for c in names if c in rows.columns), None)
        if column:
            one = rows.select(F.col(column).cast("string").alias("patient_id")).where("patient_id IS NOT NULL")
            found = one if found is None else found.union(one)
    if found is None:
        raise ValueError("no source has an id column")
    return found.distinct()


def split_categories(rows: DataFrame, column: str = "category") -> dict[str, DataFrame]:
    """A table per category (null categories are left out).

    Of rows stored by category each table reads its own only.
    """
    names = [r[0] for r in rows.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]
    return {n: rows.where(F.col(column) == n).drop(column) for n in names}


class Warehouse:
    """Collects contributions to tables and writes each table once."""

    def __init__(self, ids: DataFrame | None, births: DataFrame | None, id_columns: Iterable[str] = ("record_id", "patient_id"), approved: Iterable[str] | None = None, min_non_missing: int = 10, deidentify_dates: bool = True):
        self.ids, self.births, self.id_columns = ids, births, set(id_columns)
        self.approved = None if approved is None else set(approved)
        self.least, self.dates = min_non_missing, deidentify_dates
        self.tables: dict[str, DataFrame] = {}

    def allows(self, category: str) -> bool:
        return self.approved is None or table_name(category) in self.approved

    def prepare(self, rows: DataFrame, origin: str) -> DataFrame:
        """rename id, replace it, shift dates, strip personal columns, tag, drop sparse columns."""
        rows = rename_id(rows, self.id_columns)
        if self.ids is not None and "record_id" in rows.columns:
            rows = replace_ids(rows, self.ids)
        if self.dates and "record_id" in rows.columns:
            rows = shift_dates(rows, self.births)
        rows = strip_pii(rows, self.id_columns - {"record_id"})
        return keep_filled_columns(rows.withColumn("data_source", F.lit(origin)), self.least)

    def add(self, category: str, rows: DataFrame, origin: str) -> None:
        name = table_name(category)
        if name == COHORT:
            raise ValueError("the name cohort is reserved")
        if not self.allows(category):
            return
        rows = self.prepare(rows, origin)
        if not [c for c in rows.columns if c not in ("record_id", "data_source")]:
            return
        self.tables[name] = union_aligned(self.tables[name], rows) if name in self.tables else rows

    def add_cohort(self, cohort: DataFrame) -> None:
        self.tables[COHORT] = cohort_table(cohort)

    def write(self, folder: str) -> None:
        """All tables as a new snapshot of the folder: readers see all of it or the one before, and no table of an earlier build."""
        if not self.tables:
            return
        spark = next(iter(self.tables.values())).sparkSession
        with published(spark, folder) as snapshot:
            for name, rows in self.tables.items():
                rows.write.parquet(f"{snapshot}/{name}")


def register(spark: SparkSession, tables: Mapping[str, DataFrame]) -> None:
    for name, rows in tables.items():
        rows.createOrReplaceTempView(name)


def open_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the published snapshot, listed through Spark's file system; none before the first is published."""
    snapshot = current(spark, folder)
    return {name_of(p): spark.read.parquet(p) for p in listed(spark, snapshot) if is_folder(spark, p)} if snapshot else {}
