"""How much text goes to a worker at once."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from countstats.llm import common, mixing, queries

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unbounded(spark):
    before = spark.conf.get(NAME)
    yield spark
    spark.conf.set(NAME, before)


def largest_batch(spark):
    """Bytes of the largest batch of 200 texts of 100 kB that a task gets."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    texts = spark.range(0, 200, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
    return texts.mapInArrow(run, "n bigint").agg(F.max("n")).first()[0]


@pytest.mark.parametrize("given,bound", [("64m", common.BATCH_BYTES), ("2147483646", common.BATCH_BYTES), ("1m", 1 << 20)])
def test_batches_are_bounded_and_never_widened(unbounded, given, bound):
    unbounded.conf.set(NAME, given)
    common.bound_batches(unbounded)
    assert bound / 2 < largest_batch(unbounded) < bound + 200_000


@pytest.mark.parametrize("name", ["op8_substring_dedup", "language_id", "simhash_near_dedup", "mixing"])
def test_what_passes_whole_texts_bounds_its_batches(unbounded, sf_dir, name):
    stages = dict(corpus_pipeline.STAGES)
    docs = unbounded.read.parquet(f"{sf_dir}/documents.parquet").limit(50)
    if name in stages:
        stages[name](unbounded, docs, sf_dir)
    else:
        queries.queries()[name](unbounded, sf_dir)
    assert largest_batch(unbounded) < common.BATCH_BYTES + 200_000


def test_a_mixed_text_goes_to_its_worker_once(spark, monkeypatch):
    rows = [(i, f"w{i} " * 40, "ab"[i % 2], 7) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint")
    kind, sent = type(docs), []
    real = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **b: (sent.append(self), real(self, *a, **b))[1])
    mixed = mixing.mix(docs).collect()
    (frame,) = sent
    assert frame.filter("_text is null or _row.text is not null").count() == 0
    assert mixed and all(r["text"] and r["n_chars"] == len(r["text"]) for r in mixed)
    assert all(set(r["text"].split()) == {f"w{r['doc_id']}"} for r in mixed)
