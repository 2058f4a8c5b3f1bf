"""Ontologies as data: categories with their fields, templates, validation, proposed tables.

The built-in catalogue names the principal fields of each category, with types that follow from names;
a project adds its own with ``load_catalog`` (YAML of the same shape), or whole standards with types,
values and repeatability from folders of JSON documents (``load_folder``).
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession

from medloom.functions.names import table_name
from medloom.operators.extraction import SUMMARY, validate_extraction
from medloom.sources import files

# Names of public data standards.
_CATALOG = """
naaccr:
  version: "25.0"
  base:
    demographics: naaccr_220_sex naaccr_240_date_of_birth naaccr_250_age_at_diagnosis naaccr_160_race1 naaccr_190_spanish_hispanic_origin
    tumor_identification: naaccr_400_primary_site naaccr_410_laterality naaccr_420_histologic_type naaccr_430_behavior naaccr_440_grade naaccr_390_date_of_diagnosis
    staging: naaccr_940_tnm_clin_t naaccr_950_tnm_clin_n naaccr_960_tnm_clin_m naaccr_970_tnm_clin_stage_group naaccr_880_tnm_path_t naaccr_890_tnm_path_n naaccr_900_tnm_path_m
    treatment: naaccr_1200_rx_date_surgery naaccr_1290_rx_summ_surg_prim_site naaccr_1310_surgical_margins naaccr_1400_rx_date_radiation
  site:
    generic: {site_specific_generic: naaccr_3814_grade_clinical naaccr_3815_grade_pathological naaccr_3820_lvi naaccr_3821_perineural_invasion naaccr_3935_tumor_size}
    lung: {site_specific_lung: naaccr_3929_separate_tumor_nodules naaccr_3937_pleural_invasion naaccr_3938_alk_rearrangement naaccr_3939_egfr_mutational_analysis naaccr_3940_kras naaccr_3941_ros1}
    lung_v9: {site_specific_lung_v9: naaccr_3929_separate_tumor_nodules naaccr_3937_pleural_invasion naaccr_3938_alk_rearrangement naaccr_3939_egfr_mutational_analysis naaccr_1174_pdl1}
    breast: {site_specific_breast: naaccr_3827_er_summary naaccr_3828_er_percent naaccr_3915_pr_summary naaccr_3916_pr_percent naaccr_3855_her2_summary}
    colorectal: {site_specific_colorectal: naaccr_3890_msi naaccr_3891_mmr naaccr_3910_kras naaccr_3911_nras naaccr_3844_braf}
    kidney: {site_specific_kidney: naaccr_3919_isup_grade naaccr_3930_sarcomatoid naaccr_3931_rhabdoid}
    melanoma: {site_specific_melanoma: naaccr_3932_breslow_thickness naaccr_3933_ulceration naaccr_3894_mitotic_rate}
    prostate: {site_specific_prostate: naaccr_3920_psa_lab_value naaccr_3840_gleason_score_clin naaccr_3841_gleason_score_path}
prissmm:
  version: "2.0.0"
  base:
    patient: record_id birth_year naaccr_sex_code naaccr_race_code_primary naaccr_ethnicity_code os_status os_months
  site:
    generic: &prissmm
      cancer_diagnosis: ca_seq ca_dx_days ca_type naaccr_histology_code naaccr_primary_site ca_stage ca_tnm_t ca_tnm_n
      regimen: ca_seq regimen_number regimen_drugs drugs_num dx_reg_start_days dx_reg_end_days regimen_setting regimen_ongoing
      medical_oncologist_assessment: ca_seq md_dx_days md_ca md_ca_status md_ecog
    nsclc: {<<: *prissmm, site_specific_nsclc: ca_lung_cigarette ca_lung_pack_years egfr_status alk_status ros1_status kras_status}
    breast: {<<: *prissmm, site_specific_breast: er_status pr_status her2_status receptor_subtype ki67}
    colorectal: {<<: *prissmm, site_specific_colorectal: tumor_location tumor_sidedness kras_status nras_status braf_status msi_status mmr_status}
omop:
  version: "5.4.0"
  base: {person: person_id gender_concept_id year_of_birth race_concept_id ethnicity_concept_id}
  site:
    generic:
      condition_occurrence: condition_concept_id condition_concept_name condition_start_date condition_end_date condition_source_value
      episode: episode_concept_id episode_concept_name episode_start_date episode_end_date
      drug_exposure: drug_concept_id drug_concept_name drug_exposure_start_date drug_exposure_end_date quantity
      procedure_occurrence: procedure_concept_id procedure_date
      measurement: measurement_concept_id measurement_date value_as_number
matchminer_ai:
  version: "1.0.0"
  base:
    patient_level: age sex ecog_performance_status
    disease_status: current_disease_status disease_burden_assessments tumor_marker_trends
    clinical_trial_eligibility: brain_metastases measurable_disease organ_function prior_immunotherapy autoimmune_conditions recent_surgery active_infections
    comorbidities: comorbidities charlson_comorbidity_index medications
  site: {generic: {per_diagnosis: cancer_type histology extent_of_disease risk_category biomarkers prior_treatments}}
msk_chord:
  version: "2023.12"
  base:
    patient_summary: patient_id gender race ethnicity current_age stage_highest_recorded smoking_history
    tumor_site_summary: tumor_site_date anatomic_location
  site:
    generic:
      sample_summary: sample_id cancer_type oncotree_code sample_type primary_site metastatic_site
      timeline_diagnosis: diagnosis_date dx_description ajcc_stage
      timeline_treatment: treatment_start_date treatment_end_date agent medication_type
      timeline_surgery: surgery_date surgery_type surgery_site
      timeline_radiation: radiation_start_date radiation_end_date radiation_site
      timeline_labs: lab_date lab_type lab_value lab_unit
      timeline_biomarkers: pdl1_status mmr_status gleason_score
      timeline_clinical_status: ecog_date ecog_kps_score disease_free_status
      timeline_progression: progression_date progression_status
      timeline_sequencing: sequencing_date sample_id
      timeline_prior_medications: prior_med_date prior_med_status
      timeline_tumor_sites: tumor_site_date anatomic_location
generic_cancer:
  version: "1.0.0"
  site:
    generic: &generic
      cancer_diagnosis: primary_site overall_stage_at_diagnosis t_stage_at_diagnosis n_stage_at_diagnosis m_stage_at_diagnosis histology diagnosis_date
      cancer_biomarker: biomarker_type biomarker_tested biomarker_result
      cancer_systemic_therapy_regimen: regimen_drug_list regimen_start_date regimen_end_date regimen_toxicity_list
      cancer_surgery: surgery_type surgery_site surgery_date
      cancer_radiation_therapy: radiation_type radiation_start_date radiation_end_date radiation_site
      cancer_burden: burden_assessor_type burden_assessment_date burden_type cancer_site
      social_history: categorical_smoking_history pack_years alcohol_use substance_use
pan_top:
  version: "1.0.0"
  site:
    generic:
      cancer_diagnosis: primary_site overall_stage_at_diagnosis histology diagnosis_date
      cancer_biomarker: biomarker_type biomarker_tested biomarker_result
      cancer_systemic_therapy_regimen: regimen_drug_list regimen_start_date regimen_end_date regimen_toxicity_list
      cancer_surgery: surgery_type surgery_site surgery_date
      cancer_radiation_therapy: radiation_type radiation_start_date radiation_end_date radiation_site
      cancer_burden: burden_assessor_type burden_assessment_date burden_type cancer_site
      smoking_history: categorical_smoking_history pack_years
clinical_summary:
  version: "1.0.0"
"""


def data_type(name: str) -> str:
    """A field's declared type, from its name."""
    if "date" in name:
        return "date"
    if name.endswith(("_list", "biomarkers", "medications", "treatments")):
        return "array"
    if name.endswith(("_days", "_number", "_num", "_id", "_seq", "_year", "pack_years", "_percent", "_value", "_score", "quantity", "age", "_months")):
        return "number"
    return "string"


@dataclass(frozen=True)
class Item:
    id: str
    type: str = "string"
    description: str = ""
    repeatable: bool = False
    required: bool = False
    values: tuple[str, ...] = ()
    items: tuple[Item, ...] = ()  # of an object, its own fields


@dataclass(frozen=True)
class Category:
    id: str
    items: tuple[Item, ...]
    per_diagnosis: bool = False


@dataclass
class Ontology:
    id: str
    version: str = ""
    base: list[Category] = field(default_factory=list)
    site: dict[str, list[Category]] = field(default_factory=dict)

    def site_categories(self, cancer_type: str = "generic") -> list[Category]:
        return self.site.get(cancer_type, self.site.get("generic", []))

    def categories(self, cancer_type: str = "generic") -> list[Category]:
        return [*self.base, *self.site_categories(cancer_type)]

    def empty_summary(self) -> dict[str, Any]:
        return {"patient": {c.id: {i.id: None for i in c.items} for c in self.base}, "diagnoses": []}

    def empty_diagnosis(self, cancer_type: str = "generic") -> dict[str, Any]:
        return {c.id: {i.id: None for i in c.items} for c in self.site_categories(cancer_type)}

    def prompt(self, cancer_type: str = "generic") -> str:
        return "\n".join(f"{c.id}: " + ", ".join(_told(i) for i in c.items) for c in self.categories(cancer_type))

    def validate(self, entries: Any, cancer_type: str = "generic") -> list[str]:
        if self.id == SUMMARY:
            return [] if entries else ["the summary is empty"]
        return validate_extraction(entries, [c.id for c in self.categories(cancer_type)])


def _told(item: Item) -> str:
    """A field as a prompt names it."""
    marks = [item.type, *(["repeatable"] if item.repeatable else []), *(["one of " + " / ".join(item.values)] if item.values else [])]
    return f"{item.id} ({'; '.join(marks)})" + (f": {item.description}" if item.description else "")


def _item(raw: Mapping[str, Any]) -> Item:
    """A field from a document that describes it; an object's own fields are told in its description, too."""
    name = raw.get("json_field") or raw.get("id") or f"item_{raw.get('naaccr_item')}"
    values = raw.get("valid_values") or ()
    parts = [raw.get("description") or raw.get("name") or ""]
    if raw.get("valid_codes"):
        parts.append(f"codes: {raw['valid_codes']}")
    if raw.get("sub_items"):
        parts.append("with " + ", ".join(x["id"] for x in raw["sub_items"]))
    return Item(name, raw.get("data_type") or data_type(name), "; ".join(x for x in parts if x), bool(raw.get("repeatable")), bool(raw.get("required")), tuple(map(str, values)), tuple(map(_item, raw.get("sub_items") or ())))


def read_folder(spark: SparkSession, folder: str, name: str, version: str = "", site_folders: Iterable[str] = ("site_specific",)) -> Ontology:
    """An ontology from a folder of JSON documents, one for each category, in subfolders.

    Documents under one of ``site_folders`` belong to the cancer type they are named by; all others are
    of every patient, or of every diagnosis if they say so.  This is how a project brings the full
    field lists of a standard, of which the built-in catalogue names the principal ones.
    """
    base, every, site = [], [], {}
    sites = set(site_folders)
    for sub in files.listed(spark, folder):
        for path in files.listed(spark, sub) if files.is_folder(spark, sub) else []:
            if not path.endswith(".json"):
                continue
            raw = json.loads(files.read_text(spark, path))
            stem, special = files.stem_of(path), files.name_of(sub) in sites
            category = raw.get("category") or raw.get("category_id") or (f"site_specific_{stem}" if special else stem)
            found = Category(category, tuple(_item(x) for x in raw.get("items") or ()), special or bool(raw.get("per_diagnosis")))
            if special:
                site.setdefault(raw.get("schema_id") or stem, []).append(found)
            elif found.per_diagnosis:
                every.append(found)
            else:
                base.append(found)
    site.setdefault("generic", [])
    return Ontology(name, version, base, {k: every + own for k, own in site.items()})


def _categories(raw: Mapping[str, str] | None, per_diagnosis: bool) -> list[Category]:
    return [Category(k, tuple(Item(n, data_type(n)) for n in v.split()), per_diagnosis) for k, v in (raw or {}).items()]


def parse_catalog(text: str) -> dict[str, Ontology]:
    return {k: Ontology(k, v.get("version", ""), _categories(v.get("base"), False), {s: _categories(c, True) for s, c in (v.get("site") or {}).items()}) for k, v in yaml.safe_load(text).items()}


class Registry:
    """Known ontologies by id."""

    def __init__(self, ontologies: Mapping[str, Ontology] | None = None):
        self._known = dict(ontologies if ontologies is not None else parse_catalog(_CATALOG))

    def register(self, ontology: Ontology) -> None:
        self._known[ontology.id] = ontology

    def get(self, name: str) -> Ontology:
        if name not in self._known:
            raise ValueError(f"unknown ontology {name}; known: {', '.join(self.available())}")
        return self._known[name]

    def available(self) -> list[str]:
        return sorted(self._known)

    def all(self) -> list[Ontology]:
        return [self._known[k] for k in self.available()]

    def clear(self) -> None:
        self._known.clear()

    def load_folder(self, spark: SparkSession, folder: str, name: str, version: str = "") -> None:
        self.register(read_folder(spark, folder, name, version))

    def load_catalog(self, path: str) -> None:
        self._known |= parse_catalog(Path(path).read_text())

    def select(self, ids: Iterable[str]) -> list[Ontology]:
        ids = list(ids)
        return self.all() if ids == ["all"] else [self.get(i) for i in ids]


def combined_template(ontologies: Iterable[Ontology]) -> dict[str, Any]:
    ontologies = list(ontologies)
    meta = {"ontologies_used": [o.id for o in ontologies], "extraction_date": None, "last_note_date": None, "notes_incorporated": 0}
    return {o.id: o.empty_summary() for o in ontologies} | {"extraction_metadata": meta}


def combined_prompt(ontologies: Iterable[Ontology], cancer_type: str = "generic") -> str:
    return "\n\n".join(f"[{o.id} {o.version}]\n{o.prompt(cancer_type)}" for o in ontologies)


def items_frame(spark: SparkSession, ontologies: Iterable[Ontology]) -> DataFrame:
    """(ontology, cancer_type, category, item_id, data_type, per_diagnosis, repeatable, required)."""
    rows = [(o.id, s, c.id, i.id, i.type, c.per_diagnosis, i.repeatable, i.required) for o in ontologies for s, cs in [("", o.base), *o.site.items()] for c in cs for i in c.items]
    return spark.createDataFrame(rows, "ontology string, cancer_type string, category string, item_id string, data_type string, per_diagnosis boolean, repeatable boolean, required boolean")


def propose_tables(ontologies: Iterable[Ontology], cancer_type: str, field_mappings: Mapping[str, Any], harmonized: Iterable[str] = (), cohort_columns: Iterable[str] | None = None) -> dict[str, dict[str, list[str]]]:
    """{table: {sources, columns}}: the only tables that will be built."""
    default = ("record_id", "sex", "race", "ethnicity", "birth_to_last_followup_or_death_years", "died_yes_or_no")
    out: dict[str, dict[str, list[str]]] = {"cohort": {"sources": ["cohort builder"], "columns": list(cohort_columns or default)}}

    def add(category: str, source: str, columns: Iterable[str]) -> None:
        entry = out.setdefault(table_name(category), {"sources": [], "columns": ["record_id"]})
        entry["sources"].append(source)
        entry["columns"] += [c for c in dict.fromkeys(columns) if c not in entry["columns"] and c not in ("category", "source")]

    for o in ontologies:
        for c in o.site_categories(cancer_type):
            add(c.id, "AI extraction", (i.id for i in c.items))
    for category, items in field_mappings.items():
        if isinstance(items, list):
            add(category, "harmonized structured data", (x.get("target") for x in items if x.get("target")))
    for category in harmonized:
        if table_name(category) not in out:
            add(category, "harmonized structured data", ())
    return out
