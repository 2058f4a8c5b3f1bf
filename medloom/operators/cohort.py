"""Cohort definition: who is in, who they are, and how long they were followed.

All steps are plans: distinct ids, a semi-join on diagnosis codes, coalescing joins of demographic
sources in order, survival spans from microseconds, sequential de-identified ids.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medloom.functions.dates import parse_date, years_between
from medloom.session import settled

COHORT_COLUMNS = ("record_id", "sex", "race", "ethnicity", "birth_date", "died_yes_or_no", "birth_to_last_followup_or_death_years", "birth_to_death_years")


@dataclass
class CohortSpec:
    """Which columns of the sources mean what."""

    patient_id_column: str = "record_id"
    diagnosis_code_column: str | None = None
    diagnosis_code_filter: Sequence[str] = field(default_factory=tuple)
    sex_column: str | None = None
    race_column: str | None = None
    ethnicity_column: str | None = None
    birth_date_column: str | None = None
    death_date_column: str | None = None
    death_indicator_column: str | None = None
    followup_date: str = "2025-07-01"

    def demographics(self) -> list[str]:
        named = (self.sex_column, self.race_column, self.ethnicity_column, self.birth_date_column, self.death_date_column, self.death_indicator_column)
        return list(dict.fromkeys(c for c in named if c))


def code_matches(code: Column, codes: Sequence[str]) -> Column:
    """An unanchored search for any of the codes; null codes don't match."""
    return F.coalesce(code.cast("string").rlike("|".join(codes)), F.lit(False))


def first_row_per_key(rows: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key under a total order."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")


def with_arrival(rows: DataFrame, name: str = "_arrival") -> DataFrame:
    """Rows with their place in the scan, the order that "first row" refers to."""
    return rows.withColumn(name, F.monotonically_increasing_id())


def first_per_patient(rows: DataFrame, pid: str, columns: Sequence[str]) -> DataFrame:
    """One row per patient: the first in the scan, by a combinable aggregate (no sort, no window)."""
    placed = rows.select(F.col(pid).cast("string").alias(pid), F.struct(*[F.col(c) for c in columns]).alias("_held"), F.monotonically_increasing_id().alias("_arrival"))
    return placed.groupBy(pid).agg(F.min_by("_held", "_arrival").alias("_row")).select(pid, *[F.col("_row")[c].alias(c) for c in columns])


def coalescing_join(base: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Left join in which the source only fills what the base doesn't have."""
    have, more = base.columns, [c for c in source.columns if c != key]
    right = source.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_r_{c}") for c in more])
    joined = base.join(right, base[key] == F.col("_key"), "left")
    kept = [F.coalesce(base[c], F.col(f"_r_{c}")).alias(c) if c in more else base[c] for c in have]
    return joined.select(*kept, *[F.col(f"_r_{c}").alias(c) for c in more if c not in have])


def sequential_ids(ids: DataFrame, pid: str, prefix: str, name: str = "record_id") -> DataFrame:
    """(pid, name): ids sorted as strings, numbered from 1, at least six digits.

    The sort is a range partitioning; a partition's numbers start where the counts of those before
    end, so the numbering is distributed too.  The sorted ids are settled first: a partition that is
    computed again could otherwise hold other rows.
    """
    distinct = ids.select(F.col(pid).cast("string").alias(pid)).where(F.col(pid).isNotNull()).distinct()
    ranked = settled(distinct.repartitionByRange(F.col(pid)).sortWithinPartitions(pid).select(pid, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    counts = ranked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    ahead = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    number = F.col("_at") + F.col("_ahead") + 1
    return ranked.join(ahead, "_part").select(pid, F.format_string(f"{prefix}_%06d", number.cast("long")).alias(name))


def survival(rows: DataFrame, birth: str, death: str | None, followup: str) -> DataFrame:
    """Fractional years from birth to death or last follow-up, and to death (null if alive)."""
    born = parse_date(F.col(birth), rows.schema[birth].dataType)
    died = parse_date(F.col(death), rows.schema[death].dataType) if death else F.lit(None).cast("timestamp")
    last = F.coalesce(died, F.to_timestamp(F.lit(followup)))
    return rows.withColumns({"birth_date": born, "birth_to_last_followup_or_death_years": years_between(born, last), "birth_to_death_years": years_between(born, died)})


def build_cohort(patients: DataFrame, spec: CohortSpec, diagnoses: DataFrame | None = None, demographics: Sequence[DataFrame] = (), prefix: str = "patient") -> tuple[DataFrame, DataFrame]:
    """(cohort, id map from original to de-identified id).

    Null ids are dropped.  Later demographic sources, the patient table last, fill gaps and never
    overwrite; of several rows for a patient in one source the first counts.
    """
    pid = spec.patient_id_column
    base = patients.select(F.col(pid).cast("string").alias(pid)).where(F.col(pid).isNotNull()).distinct()
    if diagnoses is not None and spec.diagnosis_code_column and spec.diagnosis_code_filter:
        hit = diagnoses.where(code_matches(F.col(spec.diagnosis_code_column), spec.diagnosis_code_filter)).select(F.col(pid).cast("string").alias(pid))
        base = base.join(hit, pid, "left_semi")
    for source in [*demographics, patients]:
        columns = [c for c in source.columns if c != pid] if source is not patients else [c for c in spec.demographics() if c in source.columns]
        if columns and pid in source.columns:
            base = coalescing_join(base, first_per_patient(source, pid, columns), pid)
    renames = {spec.sex_column: "sex", spec.race_column: "race", spec.ethnicity_column: "ethnicity", spec.birth_date_column: "birth_date", spec.death_date_column: "death_date", spec.death_indicator_column: "died_yes_or_no"}
    rows = base.withColumnRenamed(pid, "_pid").withColumnsRenamed({k: v for k, v in renames.items() if k and k in base.columns and k != v})
    if "birth_date" in rows.columns:
        rows = survival(rows, "birth_date", "death_date" if "death_date" in rows.columns else None, spec.followup_date)
    ids = sequential_ids(rows, "_pid", prefix)
    cohort = rows.join(ids, "_pid").drop("_pid", "death_date")
    return cohort.select(*[c for c in COHORT_COLUMNS if c in cohort.columns]), ids.withColumnRenamed("_pid", "patient_id")
