"""The corpus pipeline: language, quality, near duplicates, packing.

Languages go by the classifier's rejection, quality by policy "v2" of the ledger (short texts that
nothing else speaks against stay), near copies by five-word shingles that agree to 0.8 or more.

Each stage takes the documents its predecessor kept; all but the last return them with the columns
of ``documents``, the last returns packed pieces.  SQL can express neither the trained classifier nor
the tokenizer, so there is no oracle; tests compare the stages with brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from medloom.llm import langid, packing, quality, simhash
from medloom.llm.common import remove, scratch, shared_root
from medloom.session import spread


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # eight fingerprints over sampled five-word shingles: a near copy misses all of them once in about seventy times at 0.8
    return simhash.keep_one(docs, budget=3, fingerprints=8, similarity=0.8)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language", language), ("quality", quality_rules), ("near_duplicates", near_duplicates), ("packing", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), None
    for name, stage in STAGES:
        path = f"{shared_root(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with scratch(spark):  # a stage's own tables end with it, its input once its result is stored
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
