"""Project configuration: dataclasses read from and written to YAML.

Fixed values: the names of sections and fields and their defaults are those of the YAML contract.
Sections that nothing here reads are kept as they are.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any, get_type_hints

import yaml


@dataclass
class ModelConfig:
    provider: str = "openai"
    model: str = ""
    base_url: str | None = None
    api_key: str | None = None
    max_tokens: int = 16384
    temperature: float = 0.0

    def key(self) -> str:
        """The configured key, or the provider's environment variable."""
        return self.api_key or os.environ.get(f"{self.provider.upper()}_API_KEY", "none" if self.provider == "openai" else "")


@dataclass
class ServerConfig:
    gpus: list = field(default_factory=list)
    gpus_per_server: int = 1
    base_port: int = 29500
    extra_args: dict = field(default_factory=dict)


@dataclass
class CohortConfig:
    patient_file: str | None = None
    diagnosis_file: str | None = None
    demographics_file: str | None = None
    demographics_files: list = field(default_factory=list)
    patient_id_column: str = "record_id"
    diagnosis_code_column: str | None = None
    diagnosis_code_filter: list = field(default_factory=list)
    sex_column: str | None = None
    race_column: str | None = None
    ethnicity_column: str | None = None
    birth_date_column: str | None = None
    death_date_column: str | None = None
    death_indicator_column: str | None = None
    followup_date: str = "2025-07-01"


@dataclass
class ExtractionConfig:
    llm: ModelConfig = field(default_factory=ModelConfig)
    vllm_servers: ServerConfig = field(default_factory=ServerConfig)
    ontology_ids: list = field(default_factory=lambda: ["naaccr"])
    #: Folders of JSON documents by the ontology's id; they add to the built-in catalogue or replace parts of it.
    ontology_folders: dict = field(default_factory=dict)
    cancer_type: str = "generic"
    chunk_tokens: int = 40000
    overlap_tokens: int = 200
    max_retries: int = 10
    patient_workers: int = 8
    patient_id_column: str = "record_id"
    notes_text_column: str = "text"
    notes_date_column: str = "date"
    notes_type_column: str = "note_type"
    notes_paths: list = field(default_factory=list)


@dataclass
class TrainingConfig:
    target_ontology_ids: list = field(default_factory=lambda: ["generic_cancer"])
    reward_llm: ModelConfig = field(default_factory=ModelConfig)
    reward_vllm_servers: ServerConfig = field(default_factory=ServerConfig)
    max_prompt_tokens: int = 32000
    max_patients: int | None = None


@dataclass
class DatabaseConfig:
    record_id_prefix: str = "patient"
    min_non_missing: int = 10
    forbidden_output_columns: list = field(default_factory=lambda: ["record_id"])
    deidentify_dates: bool = True


@dataclass
class QueryConfig:
    min_cell_size: int = 10
    max_query_rows: int = 500
    max_output_fraction: float = 0.5
    enforce_output_fraction: bool = False


@dataclass
class ProjectConfig:
    name: str = "project"
    input_paths: list = field(default_factory=list)
    output_dir: str = "output"
    cohort: CohortConfig = field(default_factory=CohortConfig)
    extraction: ExtractionConfig = field(default_factory=ExtractionConfig)
    database: DatabaseConfig = field(default_factory=DatabaseConfig)
    query: QueryConfig = field(default_factory=QueryConfig)
    training: TrainingConfig = field(default_factory=TrainingConfig)
    field_mappings: dict = field(default_factory=dict)
    patient_id_columns: dict = field(default_factory=dict)
    #: What else the file holds, by section (``project`` aside); written back unchanged.
    other: dict = field(default_factory=dict)

    def validate(self, exists: Callable[[str], bool]) -> list[str]:
        """What is wrong with the project; ``exists`` tells whether an input path is there."""
        missing = [f"The input path {p} does not exist." for p in self.input_paths if not exists(p)]
        return missing + ([] if self.name else ["The project needs a name."])

    def id_columns(self) -> set[str]:
        return {self.cohort.patient_id_column, self.extraction.patient_id_column, *self.patient_id_columns.values()}


def _build(kind: type, values: dict[str, Any]) -> Any:
    """A dataclass from a mapping; unknown keys are ignored, nulls leave the default."""
    hints, out = get_type_hints(kind), {}
    for f in fields(kind):
        if f.name in values and values[f.name] is not None:
            v = values[f.name]
            out[f.name] = _build(hints[f.name], v) if is_dataclass(hints[f.name]) and isinstance(v, dict) else v
    return kind(**out)


def load_config(path: str) -> ProjectConfig:
    raw = yaml.safe_load(Path(path).read_text()) or {}
    project = dict(raw.get("project") or {})
    if "input_dir" in project and not project.get("input_paths"):
        project["input_paths"] = [project["input_dir"]]
    config = _build(ProjectConfig, project | {k: v for k, v in raw.items() if k != "project"})
    known = get_type_hints(ProjectConfig)
    config.other = {k: v for k, v in raw.items() if k != "project" and k not in known}
    config.other |= {f"{k}.{f}": v for k, section in raw.items() if is_dataclass(known.get(k)) and isinstance(section, dict) for f, v in section.items() if f not in get_type_hints(known[k])}
    one = config.cohort.demographics_file
    if one and one not in config.cohort.demographics_files:
        config.cohort.demographics_files.insert(0, one)
    return config


def save_config(config: ProjectConfig, path: str) -> None:
    values = asdict(config)
    project = {k: values.pop(k) for k in ("name", "input_paths", "output_dir")}
    for k, v in values.pop("other").items():
        section, dot, name = k.partition(".")
        if dot and section in values:
            values[section][name] = v
        else:
            values[k] = v
    Path(path).write_text(yaml.safe_dump({"project": project, **values}, sort_keys=False))
