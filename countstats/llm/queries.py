"""The registered queries of this subpackage: (spark, sf_dir) -> DataFrame over the whole tables. What nulls, empty
and repeated rows give is stated by the operators that they call."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import covertree, decontaminate, fim, hnsw, language, lines, mixing, negatives, quality, sharding, simhash, substrings, tokens
from .common import bound_batches, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and tokens of every document."""
    return tokens.count_tokens(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the two thirds that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs.filter(~language.held_out(F.col("doc_id"))))
    found = language.predict(docs, model, keep=["doc_id"])
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a window of ten words of a benchmark item."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10).drop("spans")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Co-trained scores of quality of every document."""
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    found = quality.score(docs, model, keep=["doc_id"])
    return found.withColumn("keep", F.col("quality_score") >= 0.5)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without later copies of repeated runs of lines."""
    return lines.dedup_lines(table(spark, sf_dir, "documents"), min_lines=2, keep=["doc_id"])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, beside its source's target."""
    return mixing.mix_report(table(spark, sf_dir, "documents"), seed=11)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"), shards=40, keep=["doc_id"])


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without later copies of repeated passages."""
    bound_batches(spark)
    return substrings.dedup_substrings(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=2, blocks=5)
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every twentieth row of ``embeddings`` with all others."""
    return covertree.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20, scale=64.0)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of every hundredth row of ``embeddings``, after every seventh label has moved on by one."""
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", moved), F.col("id") % 100 == 0, positives=5, negatives=10, low=30, high=90, scale=256.0)


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About the 20 nearest of every twentieth row of ``embeddings``."""
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's output and of the text that is restored from it."""
    found = fim.fill_in_middle(table(spark, sf_dir, "documents"), seed=7, rate=100, spm_share=50, keep=["doc_id"])
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    restored = fim.restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_language_id, op3_decontaminate, op4_quality, op5_line_dedup, op6_mixing, op7_sharding, op8_substring_dedup, op9_simhash, op10_top_k, op11_hard_negatives, op12_nearest, op13_fill_in_middle)}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": decontaminate.ORACLE, "op5_line_dedup": lines.ORACLE, "op7_sharding": sharding.oracle_sql(shards=40), "op10_top_k": covertree.ORACLE, "op11_hard_negatives": negatives.ORACLE, "op13_fill_in_middle": fim.ORACLE}
