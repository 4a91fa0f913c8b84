"""A cube of estimators that grows: partial states of each batch are stored and merged when it is read.

A batch brings counts of some cells; a cell's counts may be spread over the batches of one call. So there are
two passes: the first sums each cell over all batches, the second makes states with the whole cells' sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import exists
from ..sources.io import write_result


def cell_totals(counts: DataFrame) -> DataFrame:
    """Pass 1. (cell_id, size_factor): what a batch adds to each cell's sum over all genes."""
    return counts.groupBy("cell_id").agg(F.sum("x").cast("double").alias("size_factor"))


def group_sizes(cells: DataFrame, totals: DataFrame, dims: list[str]) -> DataFrame:
    """``dims``, n_obs: cells with counts."""
    keyed = cells.select("cell_id", *dims).join(totals.filter("size_factor > 0"), "cell_id")
    return keyed.groupBy(*dims).agg(F.count("*").alias("n_obs"))


def states(counts: DataFrame, cells: DataFrame, totals: DataFrame, dims: list[str]) -> DataFrame:
    """Pass 2. ``dims``, gene_id, nnz, min, max, sum, s, ss: what a batch knows of each group and gene, s and
    ss being sums of x / size factor and of its square."""
    keyed = cells.select("cell_id", *dims).join(totals.filter("size_factor > 0"), "cell_id")
    v = F.col("x") / F.col("size_factor")
    rows = counts.filter("x <> 0").join(keyed, "cell_id").groupBy(*dims, "gene_id")
    return rows.agg(F.count("*").alias("nnz"), F.min("x").alias("min"), F.max("x").alias("max"), F.sum("x").alias("sum"), F.sum(v).alias("s"), F.sum(v * v).alias("ss"))


def merged(states_: DataFrame, dims: list[str]) -> DataFrame:
    """States of several batches as one: any order and any grouping of them gives the same."""
    how = {"nnz": F.sum, "min": F.min, "max": F.max, "sum": F.sum, "s": F.sum, "ss": F.sum}
    return states_.groupBy(*dims, "gene_id").agg(*[f(c).alias(c) for c, f in how.items()])


def finished(states_: DataFrame, sizes: DataFrame, dims: list[str]) -> DataFrame:
    """``dims``, gene_id, nnz, n_obs, min, max, sum, mean, sem; sem is sd(x / s) / sqrt(n)."""
    mean = F.col("s") / F.col("n_obs")
    sem = F.sqrt(F.greatest(F.col("ss") / F.col("n_obs") - mean * mean, F.lit(0.0)) / F.col("n_obs"))
    keys = dims if dims else None
    joined = states_.join(sizes, keys) if keys else states_.crossJoin(F.broadcast(sizes))  # one row
    return joined.select(*dims, "gene_id", "nnz", "n_obs", "min", "max", "sum", mean.alias("mean"), sem.alias("sem"))


def grow(path: str, batches: dict[str, DataFrame], cells: DataFrame, dims: list[str]) -> None:
    """Append ``batches`` (name -> counts) of new cells to the store at ``path``.

    A (cell, gene) stands in one batch only. Names must be new, and so must the cells: a stored state
    has been made with its cells' whole sums. What a call that was stopped has left behind is not
    counted, as a batch counts only from the last of its three tables on; the batches can then be
    added under other names.
    """
    spark = cells.sparkSession
    known = _names(spark, path)
    if clash := set(batches) & known:
        raise ValueError(f"batches {sorted(clash)} have been added before")
    for name, counts in batches.items():
        write_result(cell_totals(counts).withColumn("batch", F.lit(name)), f"{path}/totals", partition_by=["batch"], mode="append")
    stored = spark.read.parquet(f"{path}/totals")
    if known and stored.filter(F.col("batch").isin(sorted(batches))).join(stored.filter(F.col("batch").isin(sorted(known))), "cell_id", "left_semi").limit(1).count():
        raise ValueError("some of these cells are in the cube already")
    totals = stored.filter(F.col("batch").isin(sorted(batches))).groupBy("cell_id").agg(F.sum("size_factor").alias("size_factor"))
    for name, counts in batches.items():
        write_result(states(counts, cells, totals, dims).withColumn("batch", F.lit(name)), f"{path}/states", partition_by=["batch"], mode="append")
    named = F.explode(F.array(*[F.lit(n) for n in sorted(batches)])).alias("batch")
    sizes = group_sizes(cells, totals, dims).withColumn("added_with", F.array(*[F.lit(n) for n in sorted(batches)]))
    write_result(sizes, f"{path}/sizes", mode="append")
    write_result(spark.range(1).select(named), f"{path}/added", mode="append")


def _names(spark: SparkSession, path: str) -> set[str]:
    """Batches that have been added as a whole; a row for each."""
    return {r["batch"] for r in spark.read.parquet(f"{path}/added").collect()} if exists(spark, f"{path}/added") else set()


def read_cube(spark: SparkSession, path: str, dims: list[str]) -> DataFrame:
    """The cube of all batches of the store at ``path``."""
    known = sorted(_names(spark, path))
    whole: Column = F.exists("added_with", lambda b: b.isin(known))
    sizes = spark.read.parquet(f"{path}/sizes").filter(whole).groupBy(*dims).agg(F.sum("n_obs").alias("n_obs"))
    return finished(merged(spark.read.parquet(f"{path}/states").filter(F.col("batch").isin(known)), dims), sizes, dims)
