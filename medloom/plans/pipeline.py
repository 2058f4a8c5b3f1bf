"""The batch pipeline: cohort, notes, extraction, harmonisation, table proposal, tables, documents.

Stages run in the caller's order and meet only through the output folder, so each can be run alone;
unknown stages are skipped with a warning.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medloom.config import ProjectConfig
from medloom.functions.names import category_of, table_name
from medloom.ontology.catalog import Category, Registry, combined_prompt, propose_tables
from medloom.operators.cohort import CohortSpec, build_cohort, sequential_ids
from medloom.operators.extraction import SUMMARY, Model, Rounds, flatten_long, flatten_wide, is_summary_only, silver_labels, summaries
from medloom.operators.harmonize import harmonize, mapped_columns, mappings_from_config
from medloom.operators.longnotes import chunk_patients
from medloom.operators.metadata import write_documents
from medloom.operators.notes import consolidate, sorted_notes, standard_notes
from medloom.operators.records import checked, refused, typed
from medloom.operators.reward import summary_rewards, training_examples
from medloom.operators.warehouse import Warehouse, distinct_ids, open_tables, split_categories
from medloom.sources import files, io
from medloom.sources.models import factory

log = logging.getLogger(__name__)
STAGES = ("cohort", "prepare_notes", "extract", "harmonize", "propose_tables", "database", "metadata")


class Pipeline:
    def __init__(self, spark: SparkSession, config: ProjectConfig, model: Callable[[int], Model] | None = None, registry: Registry | None = None, label_model: Callable[[int], Model] | None = None):
        self.spark, self.config, self.label_model = spark, config, label_model
        self.model = model or factory(config.extraction.llm, config.extraction.vllm_servers)
        self.registry = registry or Registry()
        for name, folder in config.extraction.ontology_folders.items():
            self.registry.load_folder(spark, folder, name)
        self.out = config.output_dir.rstrip("/") or "/"

    def run(self, stages: Sequence[str] = STAGES, resume: bool = True) -> None:
        for problem in self.config.validate(lambda path: files.exists(self.spark, path)):
            log.warning(problem)
        for stage in stages:
            if stage not in STAGES:
                log.warning("unknown stage %s skipped", stage)
            elif stage == "extract":
                self.extract(resume)
            else:
                getattr(self, stage)()

    def _read(self, name: str | None) -> DataFrame | None:
        path = io.find_file(self.spark, name, self.config.input_paths) if name else None
        return io.read_file(self.spark, path) if path else None

    def _table(self, name: str) -> DataFrame | None:
        path = f"{self.out}/{name}"
        if files.exists(self.spark, path):
            return self.spark.read.parquet(path)
        other = f"{self.out}/{files.stem_of(name)}.csv"
        return io.read_file(self.spark, other) if files.exists(self.spark, other) else None

    def _cohort_ids(self) -> DataFrame | None:
        return self._table("cohort_ids.parquet")

    def cohort(self) -> None:
        c = self.config.cohort
        inputs = io.resolve_files(self.spark, self.config.input_paths)
        path = io.find_file(self.spark, c.patient_file, self.config.input_paths) if c.patient_file else io.detect_patient_file(self.spark, inputs, c.patient_id_column)
        if not path:
            raise FileNotFoundError("no input file has the patient id column")

        def renamed(name: str) -> DataFrame | None:
            rows = self._read(name)
            source = io.id_column_of(name, self.config.patient_id_columns, c.patient_id_column)
            return rows.withColumnRenamed(source, c.patient_id_column) if rows is not None and source in rows.columns else rows

        patients = renamed(path)
        spec = CohortSpec(**{k: getattr(c, k) for k in CohortSpec.__dataclass_fields__})
        cohort, ids = build_cohort(patients, spec, renamed(c.diagnosis_file) if c.diagnosis_file else None, [d for f in c.demographics_files if (d := renamed(f)) is not None], self.config.database.record_id_prefix)
        ids.write.mode("overwrite").parquet(f"{self.out}/id_map.parquet")
        cohort.write.mode("overwrite").parquet(f"{self.out}/cohort.parquet")
        io.write_ids(self.spark.read.parquet(f"{self.out}/id_map.parquet").select("patient_id"), self.out)

    def prepare_notes(self) -> None:
        e = self.config.extraction
        found = []
        for k, f in enumerate(io.resolve_files(self.spark, e.notes_paths)):
            rows = standard_notes(io.read_file(self.spark, f), k, io.id_column_of(f, self.config.patient_id_columns, e.patient_id_column), "patient_id", e.notes_text_column, e.notes_date_column, e.notes_type_column)
            if rows is None:
                log.warning("%s has no ids or texts; skipped", f)
            else:
                found.append(rows)
        if not found:
            log.warning("no notes")
            return
        sorted_notes(consolidate(found, self._cohort_ids()), date=e.notes_date_column).write.mode("overwrite").parquet(f"{self.out}/notes.parquet")

    def _notes(self) -> DataFrame | None:
        """The cohort's notes."""
        e = self.config.extraction
        path = io.first_existing(self.spark, self.out, ("notes.parquet", "notes.csv"), self.config.input_paths)
        if not path:
            return None
        notes = io.read_file(self.spark, path)
        if e.patient_id_column in notes.columns and "patient_id" not in notes.columns:
            notes = notes.withColumnRenamed(e.patient_id_column, "patient_id")
        if (ids := self._cohort_ids()) is not None:
            notes = notes.withColumn("patient_id", F.col("patient_id").cast("string")).join(ids, "patient_id", "left_semi")
        return notes

    def _chunks(self) -> DataFrame | None:
        """Their chunks, stored."""
        e, stored = self.config.extraction, f"{self.out}/chunks.parquet"
        if (notes := self._notes()) is None:
            return None
        chunks = chunk_patients(notes, e.chunk_tokens, e.overlap_tokens, text=e.notes_text_column, date=e.notes_date_column, kind=e.notes_type_column)
        chunks.write.mode("overwrite").parquet(stored)
        return self.spark.read.parquet(stored)

    def extract(self, resume: bool = True) -> None:
        """Rounds that lack a patient go to the model; if none does, no model is needed."""
        e = self.config.extraction
        chunks = self._chunks()
        if chunks is None:
            log.warning("no notes; extraction skipped")
            return
        summary_only = is_summary_only(e.ontology_ids)
        prompt = combined_prompt(self.registry.select(e.ontology_ids), e.cancer_type)
        rounds = Rounds(self.spark, f"{self.out}/rounds", prompt, summary_only, e.patient_workers, e.max_retries)
        if resume and not rounds.pending(chunks):
            latest = rounds.latest()
        elif self.model is None:
            log.warning("no model; extraction skipped")
            return
        else:
            latest = rounds.run(chunks, self.model, resume)
        if summary_only:
            summaries(latest).write.mode("overwrite").parquet(f"{self.out}/summaries.parquet")
        else:  # by category, so that each table reads its own rows only
            flatten_wide(flatten_long(latest)).write.mode("overwrite").partitionBy("category").parquet(f"{self.out}/extractions.parquet")

    def records(self) -> DataFrame | None:
        """Typed tables of the stored extractions, one for each category of the chosen ontologies, and the quarantine of refused entries with reasons."""
        e = self.config.extraction
        latest = Rounds(self.spark, f"{self.out}/rounds").latest()
        ontologies = [o for o in self.registry.select(e.ontology_ids) if o.id != SUMMARY]
        items: dict[str, dict] = {}  # a category of several ontologies has all their fields
        for c in (c for o in ontologies for c in o.categories(e.cancer_type)):
            items.setdefault(c.id, {}).update({i.id: i for i in c.items})
        categories = {n: Category(n, tuple(i.values())) for n, i in items.items()}
        if not categories:
            log.warning("no categories; records skipped")
            return None
        checked(latest, categories.values()).write.mode("overwrite").parquet(f"{self.out}/records/checked.parquet")
        entries = self.spark.read.parquet(f"{self.out}/records/checked.parquet")
        for name in sorted(r.category for r in entries.where("size(faults) = 0").select("category").distinct().collect()):  # at most the catalogue's
            typed(entries, categories[name]).write.mode("overwrite").parquet(f"{self.out}/records/{table_name(name)}.parquet")
        refused(entries).write.mode("overwrite").parquet(f"{self.out}/records/refused.parquet")
        return self.spark.read.parquet(f"{self.out}/records/refused.parquet")

    def labels(self) -> DataFrame | None:
        """Extractions to train against, by the reward model, with prompts from the cohort's notes; made once."""
        t, e = self.config.training, self.config.extraction
        model = self.label_model or factory(t.reward_llm, t.reward_vllm_servers)
        chunks = self._chunks()
        if chunks is None or model is None:
            log.warning("no notes or no reward model; labels skipped")
            return None
        prompt = combined_prompt(self.registry.select(t.target_ontology_ids), e.cancer_type)
        return silver_labels(self.spark, chunks, f"{self.out}/labels", model, prompt, e.patient_workers, e.max_retries)

    def training(self) -> DataFrame | None:
        """(patient_id, prompt, label): what a model of summaries is trained on, from notes and labels; stored."""
        t, e = self.config.training, self.config.extraction
        labels = self.labels()
        if labels is None:
            return None
        notes = self._notes()
        rows = training_examples(notes, labels, combined_prompt([self.registry.get(SUMMARY)], e.cancer_type), t.max_patients, max_prompt_tokens=t.max_prompt_tokens, text=e.notes_text_column, date=e.notes_date_column, kind=e.notes_type_column)
        rows.write.mode("overwrite").parquet(f"{self.out}/training.parquet")
        return self.spark.read.parquet(f"{self.out}/training.parquet")

    def rewards(self, path: str) -> DataFrame | None:
        """(patient_id, sample, reward) of a file of summaries against the stored labels; stored beside them."""
        t, e = self.config.training, self.config.extraction
        labels = self.labels()
        model = self.label_model or factory(t.reward_llm, t.reward_vllm_servers)
        if labels is None or model is None:
            return None
        prompt = combined_prompt(self.registry.select(t.target_ontology_ids), e.cancer_type)
        stored = f"{self.out}/rewards/{files.stem_of(path)}"
        found = summary_rewards(self.spark, io.read_file(self.spark, path), labels, f"{stored}/rounds", model, prompt, e.patient_workers, e.max_retries)
        found.write.mode("overwrite").parquet(f"{stored}/rewards.parquet")
        return self.spark.read.parquet(f"{stored}/rewards.parquet")

    def harmonize(self) -> None:
        mappings = mappings_from_config(self.config.field_mappings)
        wanted = {m.source for m in mappings}
        inputs = io.files_with_mapped_columns(self.spark, io.resolve_files(self.spark, self.config.input_paths), wanted) if wanted else []
        pid = self.config.cohort.patient_id_column
        for f in inputs:
            rows = io.read_file(self.spark, f)
            source = io.id_column_of(f, self.config.patient_id_columns, pid)
            if source != pid and source in rows.columns and pid not in rows.columns:
                rows = rows.withColumnRenamed(source, pid)
            if pid not in rows.columns or not mapped_columns(mappings, rows.columns):
                continue
            rows = rows.withColumn(pid, F.col(pid).cast("string"))
            if (ids := self._cohort_ids()) is not None:
                rows = rows.join(ids.withColumnRenamed("patient_id", pid), pid, "left_semi")
            key = files.name_of(f).replace(".", "_")
            for category, table in harmonize(rows, mappings, pid).items():
                table.write.mode("overwrite").parquet(f"{self.out}/harmonized/{key}_{category}.parquet")

    def _harmonized(self) -> list[tuple[str, str]]:
        known = list(self.config.field_mappings)
        return [(category_of(files.stem_of(p), known), p) for p in files.listed(self.spark, f"{self.out}/harmonized") if p.endswith(".parquet")]

    def propose_tables(self) -> dict:
        e = self.config.extraction
        cohort = self._table("cohort.parquet")
        found = propose_tables(self.registry.select([o for o in e.ontology_ids if o == "all" or o in self.registry.available()]), e.cancer_type, self.config.field_mappings, [c for c, _ in self._harmonized()], cohort.columns if cohort is not None else None)
        files.write_text(self.spark, f"{self.out}/proposed_tables.json", json.dumps(found, indent=2))
        return found

    def database(self) -> None:
        d = self.config.database
        proposed = f"{self.out}/proposed_tables.json"
        approved = json.loads(files.read_text(self.spark, proposed)) if files.exists(self.spark, proposed) else None
        cohort, ids = self._table("cohort.parquet"), self._table("id_map.parquet")
        extracted = self._table("extractions.parquet")
        harmonized = [(c, self.spark.read.parquet(p)) for c, p in self._harmonized()]
        id_columns = self.config.id_columns() | {"patient_id", "record_id"}
        if ids is None:
            ids = sequential_ids(distinct_ids([r for r in [extracted, *[x for _, x in harmonized]] if r is not None], sorted(id_columns)), "patient_id", d.record_id_prefix)
        births = cohort.select("record_id", "birth_date") if cohort is not None and "birth_date" in cohort.columns else None
        house = Warehouse(ids, births, id_columns, approved, d.min_non_missing, d.deidentify_dates)
        if cohort is not None:
            house.add_cohort(cohort)
        if extracted is not None:
            for category, rows in split_categories(extracted).items():
                house.add(category, rows.withColumnRenamed("patient_id", "record_id"), "ai")
        for category, rows in harmonized:
            house.add(category, rows, "structured_data")
        house.write(f"{self.out}/database")

    def metadata(self) -> None:
        tables = open_tables(self.spark, f"{self.out}/database")
        write_documents(tables, f"{self.out}/metadata", self.config.name, self.config.database.forbidden_output_columns, self.config.query.min_cell_size)
