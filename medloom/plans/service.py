"""The guarded query service: validate, run, suppress, cap, answer."""

from __future__ import annotations

import math
import threading
import uuid
from collections.abc import Iterable, Mapping
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medloom.operators.metadata import schema_document, summary_document
from medloom.operators.privacy import OutputTooLarge, complementary_cells, suppress_cells, validate_output_size
from medloom.operators.warehouse import register
from medloom.plans.clauses import AsOf, as_of_joins
from medloom.plans.dialect import DialectError, to_spark
from medloom.plans.groupsize import Masked, mask_small_groups
from medloom.plans.sqlguard import counted_outputs, lineage_leaks, planned_counts, validate
from medloom.session import settled

_NAMES = threading.Lock()


def guarded_frame(spark: SparkSession, sql: str, tables: Iterable[str], k: int = 10, forbidden: Iterable[str] = ("record_id",), count_columns: Iterable[str] | None = None, strict: bool = False) -> tuple[DataFrame, list[str], list[str]]:
    """(suppressed result as a plan, its count columns, warnings); raises ValueError for refused SQL."""
    forbidden, sql = list(forbidden), sql.strip().rstrip(";")
    tables = list(tables)
    joins: list[AsOf] = []
    if "asof" in sql.lower():
        sql, joins = as_of_joins(sql, {t: spark.table(t).columns for t in tables}, f"asof_{uuid.uuid4().hex}_")
    try:
        for join in joins:
            joined = join.frame(spark.table(join.left), spark.table(join.right))
            joined.createOrReplaceTempView(join.name)
            # the right table's forbidden columns stay forbidden under their new names
            hidden = {f.lower() for f in forbidden}
            ours, theirs = ({c.lower() for c in spark.table(t).columns} & hidden for t in (join.left, join.right))
            if ours and theirs and not any(a.lower() in ours and b.lower() in theirs for a, b in join.keys):
                raise ValueError("ASOF JOIN of two tables of persons has to be by person.")
            forbidden += [join.column(c) for c in spark.table(join.right).columns if c.lower() in hidden]
        return _guarded(spark, sql, [*tables, *(j.name for j in joins)], k, forbidden, count_columns, strict)
    finally:
        for join in joins:
            spark.catalog.dropTempView(join.name)


def _guarded(spark: SparkSession, sql: str, tables: list[str], k: int, forbidden: list[str], count_columns: Iterable[str] | None, strict: bool) -> tuple[DataFrame, list[str], list[str]]:
    try:
        text = to_spark(sql)
    except DialectError as error:
        raise ValueError(str(error)) from error
    verdict = validate(spark, text, tables, forbidden, strict)
    if not verdict.valid:
        raise ValueError(" ".join(verdict.errors))
    rows = spark.sql(text)
    analyzed = rows._jdf.queryExecution().analyzed()
    if strict and (bad := lineage_leaks(analyzed, forbidden)):
        raise ValueError(f"Forbidden values would be shown in: {', '.join(bad)}.")
    # by the caller's own words (rewritten functions use counts of their own) and by what the outputs are made of
    places = sorted({*_planned(spark, sql, text), *counted_outputs(analyzed)})
    planned = [rows.columns[p] for p in places if p < len(rows.columns)]
    asked = list(count_columns or []) + planned if count_columns else None
    # aggregates of groups below k are null from here on, wherever the statement makes them
    masked = mask_small_groups(spark, text, k, {t: spark.table(t).columns for t in tables}, forbidden)
    hidden = spark.sql(masked.sql)
    hidden = hidden.toDF(*rows.columns, *hidden.columns[len(rows.columns) :])
    if masked.dimensions:
        hidden = _with_complement(hidden, masked, {*planned, *(count_columns or [])}, k)
    shown, counts = suppress_cells(hidden, k, forbidden, asked, planned, {*planned, *(count_columns or [])})
    if masked.dimensions:
        made = [c for c, is_made in zip(rows.columns, masked.made, strict=True) if is_made]
        text_of = dict(shown.dtypes)
        second = [F.when(~F.col("__second"), F.col(f"`{c}`")).otherwise(F.lit("suppressed") if text_of[c] == "string" else F.lit(None)).alias(c) if c in made else F.col(f"`{c}`") for c in shown.columns if not c.startswith("__")]
        shown = shown.orderBy("__place").select(*second)
    return shown, counts, verdict.warnings


def _with_complement(rows: DataFrame, masked: Masked, counts: set[str], k: int) -> DataFrame:
    """The rows with their order (``__place``) and whether they are hidden for the sake of others (``__second``)."""
    cells = settled(rows.withColumn("__place", F.monotonically_increasing_id()))
    kinds = dict(cells.dtypes)
    small = [F.coalesce(F.col(f"`{c}`") < k, F.lit(True)) for c in counts if kinds.get(c) in ("bigint", "int")]
    more = complementary_cells(cells.withColumn("__hidden", reduce(lambda a, b: a | b, small, F.col("__hidden"))), masked.dimensions)
    return cells.withColumn("__second", F.col("__place").isin(more) if more else F.lit(False)).drop("__hidden", "__size", *(f"__{n}_{i}" for i in range(masked.dimensions) for n in ("dim", "all")))


def _planned(spark: SparkSession, sql: str, rewritten: str) -> list[int]:
    try:
        return planned_counts(spark, sql)
    except PySparkException:
        return planned_counts(spark, rewritten)


def _plain(value: Any) -> Any:
    if isinstance(value, float) and math.isnan(value):
        return None
    return float(value) if isinstance(value, Decimal) else value


class QueryService:
    """Answers aggregate questions over published tables.

    No aggregate of fewer than k rows or persons has a value, in whatever spelling the statement makes it (see
    ``groupsize``).  Columns that hold counts, followed through the analysed plan, show ``<k`` in its place,
    also for small counts within larger groups; all others are null.
    """

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame], k: int = 10, max_rows: int = 500, forbidden: Iterable[str] = ("record_id",), project: str = "Dataset", strict: bool = False, max_fraction: float | None = None):
        self.spark, self.tables, self.k, self.max_rows = spark, dict(tables), k, max_rows
        self.forbidden, self.project, self.strict, self.max_fraction = list(forbidden), project, strict, max_fraction
        spark.conf.set("spark.sql.runSQLOnFiles", "false")

    def execute(self, sql: str, count_columns: Iterable[str] | None = None) -> dict[str, Any]:
        try:
            # names are the session's: they are bound to this service's tables while its statement is analysed
            with _NAMES:
                register(self.spark, self.tables)
                shown, counts, warnings = guarded_frame(self.spark, sql, self.tables, self.k, self.forbidden, count_columns, self.strict)
        except ValueError as error:
            return {"error": str(error)}
        except PySparkException as error:
            return {"error": f"Query execution error: {str(error).splitlines()[0]}"}
        try:
            rows = shown.limit(self.max_rows + 1).collect()  # bounded by the cap
            if len(rows) > self.max_rows:
                return {"error": f"The query returns {shown.count()} rows; at most {self.max_rows} are allowed. Aggregate further."}
            if self.max_fraction is not None and "cohort" in self.tables:
                validate_output_size(len(rows), self.tables["cohort"].count(), self.max_fraction)
        except OutputTooLarge as error:
            return {"error": str(error)}
        except PySparkException as error:
            return {"error": f"Query execution error: {str(error).splitlines()[0]}"}
        values = [[_plain(v) for v in r] for r in rows]
        hidden = any(v == f"<{self.k}" for r in values for v in r)
        if hidden:
            warnings = [*warnings, f"Counts < {self.k} were suppressed in columns: {counts}"]
        at = [k for k, c in enumerate(shown.columns) if c in counts]
        for r in values:  # counts that are shown are numbers again
            for p in at:
                if isinstance(r[p], str) and r[p].lstrip("-").isdigit():
                    r[p] = int(r[p])
        return {"columns": shown.columns, "rows": values, "n_rows": len(values), "warnings": warnings, "suppression_applied": hidden}

    def schema(self) -> str:
        return schema_document(self.tables, self.project, self.forbidden)

    def summary(self) -> str:
        return summary_document(self.tables, self.project, self.forbidden, self.k)
