"""Rewards of summaries and training sets, with models that are stubs."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from medloom.config import ProjectConfig
from medloom.operators import reward
from medloom.plans.pipeline import Pipeline

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Telling:
    """Repeats the JSON that a summary holds; fails for some."""

    def generate(self, prompt):
        told = prompt.split("Notes:\n")[1].split("\n\nAnswer")[0]
        if told.startswith("fail"):
            raise OSError(told)
        return told


class Broken:
    def generate(self, prompt):
        raise AssertionError("nobody is asked again")


def entry(**fields):
    return json.dumps([{"dx": fields}])


def test_rewards(spark, tmp_path):
    labels = spark.createDataFrame([("a", entry(site="lung", stage="IV")), ("b", "[]"), ("c", entry(site="breast")), ("d", entry(site="colon")), ("e", None), ("g", entry(site=None))], "patient_id string, extraction string")
    rows = [
        ("a", "1", entry(site="Lung ", stage="iv")),  # all told
        ("a", "2", entry(site="lung")),  # half of it: precision 1, recall 1/2
        ("a", "3", entry(site="liver", stage="IV")),  # one wrong value: 5/8
        ("a", "4", None), ("a", "5", "  "), ("a", "6", "no list"), ("a", "7", "fail"),
        ("a", "8", entry(site="lung")), ("a", "8", entry(site="lung", stage="IV")),  # the last in order of text
        ("a", None, "[]"), ("b", "1", entry(site="lung")), ("c", "1", entry(other="x")), ("e", "1", entry(site="x")), ("f", "1", entry(site="x")),
        ("g", "1", entry(site=None)), ("g", "2", entry(site="x")), (None, "1", entry(site="x")),
    ]
    summaries = spark.createDataFrame(rows, "patient_id string, sample string, summary string")
    make = lambda model: {(r.patient_id, r.sample): r.reward for r in reward.summary_rewards(spark, summaries, labels, str(tmp_path / "r"), lambda task: model, retries=1, workers=4, each=50).collect()}
    got = make(Telling())
    want = dict.fromkeys(((p, s) for p, s, _ in rows), 0.0) | {("a", "1"): 1.0, ("a", "2"): pytest.approx(2 / 3), ("a", "3"): 0.625, ("a", "8"): pytest.approx(2 / 3), ("g", "1"): 1.0}
    assert got == want
    assert make(Broken()) == got  # stored answers


def test_no_samples_and_no_rows(spark, tmp_path):
    labels = spark.createDataFrame([("1", entry(site="lung"))], "patient_id string, extraction string")
    one = spark.createDataFrame([(1, entry(site="lung"))], "patient_id int, summary string")
    assert [tuple(r) for r in reward.summary_rewards(spark, one, labels, str(tmp_path / "a"), lambda task: Telling()).collect()] == [("1", None, 1.0)]
    assert reward.summary_rewards(spark, one.where("false"), labels, str(tmp_path / "b"), lambda task: Broken()).count() == 0


def test_training_and_rewards_of_a_project(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "notes.csv").write_text("mrn,body,note_date\n" + "".join(f"{i},a note with several words {i},2016-01-01\n" for i in range(6)))
    (src / "told.csv").write_text("patient_id,summary\n0,about nought\n1,about one\n9,about nobody\n")
    config = ProjectConfig("demo", [str(src)], str(out))
    config.extraction.patient_id_column, config.extraction.notes_text_column, config.extraction.notes_paths = "mrn", "body", [str(src / "notes.csv")]
    config.training.max_prompt_tokens, config.training.max_patients = 8, 4
    model = lambda task: type("M", (), {"generate": lambda s, p: entry(site="lung")})()
    p = Pipeline(spark, config, label_model=model)
    p.prepare_notes()
    rows = p.training().orderBy("patient_id").collect()
    assert [r.patient_id for r in rows] == ["0", "1", "2", "3"] and all(r.label == entry(site="lung") for r in rows)
    assert rows[2].prompt.endswith("Notes:\n--- unknown | 2016-01-01 ---\nNote date: 2016-01-01") and rows[2].prompt.count("\n") >= 4
    got = {r.patient_id: r.reward for r in p.rewards(str(src / "told.csv")).collect()}
    assert got == {"0": 1.0, "1": 1.0, "9": 0.0}
    assert spark.read.parquet(str(out / "rewards" / "told" / "rewards.parquet")).agg(F.sum("reward")).first()[0] == 2.0
