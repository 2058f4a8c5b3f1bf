"""Typed records and their quarantine."""

import datetime
import json

from medloom.config import ProjectConfig
from medloom.ontology.catalog import Category, Item
from medloom.operators import records
from medloom.plans.pipeline import Pipeline

BURDEN = Category("burden", (
    Item("kind", values=("CT", "MRI"), required=True), Item("count", "integer"), Item("score", "number"), Item("sure", "boolean"), Item("seen", "date"), Item("sites", "array"),
    Item("visits", "array", items=(Item("day", "date", required=True), Item("dose", "number"))), Item("last", "object", items=(Item("day", "date"),)),
))
OTHER = Category("other", (Item("note"),))


def entries(spark, *answers):
    rows = spark.createDataFrame([(f"p{k}", a, "x") for k, a in enumerate(answers)], "patient_id string, extraction string, category string")
    return records.checked(rows, [BURDEN, OTHER])


def test_types_follow_the_catalogue():
    assert records.record_type(BURDEN).simpleString() == "struct<kind:string,count:bigint,score:double,sure:boolean,seen:date,sites:array<string>,visits:array<struct<day:date,dose:double>>,last:struct<day:date>>"


def test_values_are_parsed(spark):
    good = {"kind": "CT", "count": "12.0", "score": "-1.5e1", "sure": "TRUE", "seen": "2020-02-29", "sites": "lung", "visits": [{"day": "2021-01-01", "dose": 2}, None, {"day": "2021-01-02"}], "last": {"day": ""}}
    found = records.typed(entries(spark, json.dumps([{"other": {}}, {"burden": good}])), BURDEN)
    assert found.schema["visits"].dataType == records.field_type(BURDEN.items[6])
    (row,) = found.collect()
    day = datetime.date
    assert (row.patient_id, row.entry_no, row.kind, row["count"], row.score, row.sure, row.seen, row.sites) == ("p0", 1, "CT", 12, -15.0, True, day(2020, 2, 29), ["lung"])
    assert [tuple(v) for v in row.visits] == [(day(2021, 1, 1), 2.0), (day(2021, 1, 2), None)] and row["last"].day is None


FAULTS = [
    ({}, []),
    ({"kind": "PET"}, ["kind: not an allowed value"]),
    ({"kind": None}, ["kind: missing"]),
    ({"kind": " "}, ["kind: missing"]),
    ({"kind": ["CT"]}, ["kind: one value expected"]),
    ({"kind": {"a": 1}}, ["kind: no single value"]),
    ({"count": 1.5}, ["count: no integer"]),
    ({"count": 10**30}, ["count: no integer"]),
    ({"score": "1d"}, ["score: no number"]),
    ({"sure": "yes"}, ["sure: no boolean"]),
    ({"seen": "2021-02-29"}, ["seen: no date"]),
    ({"seen": "2021"}, ["seen: no date"]),
    ({"sites": ["a", ["b"]]}, ["sites: no single value"]),
    ({"sites": []}, []),
    ({"visits": [{"dose": "x"}, {"dose": "x"}, 3]}, ["visits.dose: no number", "visits.day: missing", "visits: no object"]),
    ({"visits": {"day": "2020-01-01", "hour": 1}}, ["visits.hour: unknown field"]),
    ({"last": {}}, []),
    ({"new": None, "score": "?"}, ["new: unknown field", "score: no number"]),
]


def test_faults(spark):
    bad = records.refused(entries(spark, *[json.dumps([{"burden": {"kind": "CT"} | fields}]) for fields, _ in FAULTS])).collect()
    found = {r.patient_id: sorted(r.reasons) for r in bad}
    assert [found.get(f"p{k}", []) for k in range(len(FAULTS))] == [sorted(said) for _, said in FAULTS]


def test_odd_answers(spark):
    found = entries(spark, None, "", "prose", "{}", "[]", "[1, null, {}]", '[{"a": {}, "b": {}}]', '[{"nobody": {}}]', '[{"other": []}]', '[{"other": {"note": 1, "note": 2}}]', '[{"other": {"note": "' + "x" * 300_000 + '"}}]')
    assert {(r.patient_id, r.entry_no, *r.reasons) for r in records.refused(found).collect()} == {
        ("p1", None, "no list"), ("p2", None, "no list"), ("p3", None, "no list"), ("p9", None, "no list"),
        ("p5", 0, "no single-key object"), ("p5", 1, "no single-key object"), ("p5", 2, "no single-key object"), ("p6", 0, "no single-key object"),
        ("p7", 0, "unknown category"), ("p8", 0, "no fields"),
    }
    (row,) = records.typed(found, OTHER).collect()
    assert (row.patient_id, len(row.note)) == ("p10", 300_000)
    assert entries(spark).count() == 0


def test_nothing_is_shuffled(spark):
    plan = entries(spark, "[]")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "CartesianProduct" not in plan


def test_records_of_a_project(spark, tmp_path):
    config = ProjectConfig()
    config.output_dir, config.extraction.ontology_ids = str(tmp_path), ["pan_top"]
    good = {"cancer_surgery": {"surgery_type": "a", "surgery_date": "2020-01-02"}}
    answers = [("p1", json.dumps([good, {"smoking_history": {"pack_years": "many"}}])), ("p2", json.dumps([{"nothing": {}}]))]
    spark.createDataFrame([(p, 0, a, 1) for p, a in answers], "patient_id string, round int, extraction string, num_chunks int").write.json(f"{tmp_path}/rounds/round=0000")
    said = {(r.patient_id, *r.reasons) for r in Pipeline(spark, config).records().collect()}
    assert said == {("p1", "pack_years: no number"), ("p2", "unknown category")}
    (folder,) = [f for f in (tmp_path / "records").iterdir() if "surgery" in f.name]
    (row,) = spark.read.parquet(str(folder)).collect()
    assert (row.patient_id, row.surgery_date, row.surgery_site) == ("p1", datetime.date(2020, 1, 2), None)
