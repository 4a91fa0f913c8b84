"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What separates words of letters, digits and non-ASCII characters.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: ASCII white space; what lies between is one word.
NOT_SPACE = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a worker turns into Python objects at once.
SLICE_BYTES = 2 << 20
#: Bytes of an Arrow batch at most, beside one row; see ``bound_batches``.
BATCH_BYTES = 4 << 20


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z in lower case and all other characters as they are."""
    return F.translate(text, _UPPER, _UPPER.lower())


def count_words(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE)), F.lit(0)).cast("long")


def by_bytes(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of the texts in ``column``, and at least one row: what a worker turns into
    Python objects at once. A text counts some bytes more than it has, so that empty ones are bounded too."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first, size = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if size and size + n > most:
            yield batch.slice(first, i - first)
            first, size = i, 0
        size += n + 64
    if first < len(batch):
        yield batch.slice(first)


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Arrow batches of ``most`` bytes at most in this session, unless they are smaller already.

    By default 10,000 rows or 64 MB go to a worker at once, and the JVM keeps buffers of twice that for each
    task. Operators leave the session alone; what runs them over whole texts calls this. Of results only op8's depend
    on it, as they do on partitions: a copy is grown along the first copy among the texts at hand.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    used = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if used > most:
        spark.conf.set(name, str(most))


def tasks_for(spark: SparkSession) -> int:
    """A number of tasks for rows that are few bytes but much work, and so must not be joined to few tasks by their size."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def clean_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id`` (long), ``v`` (components as double), ``dim`` and ``keep``; rows whose vector is null or holds a null or
    non-finite component are left out. A null id stays: such a row is a candidate like any other."""
    v = F.col(vector_col).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(v.isNotNull() & F.coalesce(good, F.lit(False)))
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.size(vector_col).alias("dim"), *keep)


def whole_vectors(vectors: DataFrame, scale: float, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """``clean_vectors`` with floor(scale * x) for each component x; one beyond 2 ** 62 is an error."""
    whole = lambda x: F.when(F.abs(x * scale) < 2.0**62, F.floor(x * scale).cast("double")).otherwise(F.raise_error(F.lit("a scaled component is beyond 2 ** 62")).cast("double"))
    return clean_vectors(vectors, id_col, vector_col, keep).withColumn("v", F.transform("v", whole))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
