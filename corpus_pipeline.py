"""The corpus pipeline: each stage works on all that the one before it kept, written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from countstats.functions.lineage import remove_folder, shared_folder
from countstats.llm import decontaminate, language, mixing, sharding, simhash
from countstats.llm.common import bound_batches

#: A document goes if no language has at least this share of belief, or if its text has no letter.
MIN_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled documents; keep those whose language is clear. Without any label there
    is nothing to judge by, and all stay."""
    bound_batches(spark)
    model = language.learn(docs)
    return language.predict(docs, model, min_score=MIN_LANGUAGE_SCORE).select(*docs.columns) if model.languages else docs


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    bound_batches(spark)
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of a benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take the words of each source in the proportion of its weight."""
    bound_batches(spark)
    return mixing.mix(docs, seed=11)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put every row into one of 40 shards, with its slot."""
    return sharding.assign_shards(docs, shards=40)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: SQL can't express the fingerprints, the learned languages or the draws; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared checkpoint folder and read again. What a
    stage has read is removed once its own result is written; the last one's input stays, as the
    result reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove_folder(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
