"""Products of features over cells, by blocks: features x cells are cut into tiles, a tile's product is one
product of matrices, and partial products over blocks of cells are added up. No row is made for a pair and a cell."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import materialize

#: Features and cells of a block, about: what a task holds of two blocks is bounded, even if no count is zero.
FEATURES = 256
CELLS = 8192


def _dense(entries: pa.ListScalar, rows: int) -> np.ndarray:
    """The matrix (cells x features) of a block's (cell, feature, value)."""
    cells, features, v = (entries.values.field(c).to_numpy() for c in ("ci", "gi", "v"))
    out = np.zeros((rows, int(features.max()) + 1))
    out[cells, features] = v
    return out


def _placed(rows: DataFrame, key: str, by: list[str], size: int, block: str, place: str) -> DataFrame:
    """``rows`` with a block of about ``size`` rows of equal ``by``, by a hash of ``key``, and a place in it from 0."""
    counts = materialize(rows.groupBy(*by).agg(F.ceil(F.count("*") / size).alias("_blocks")))
    named = counts.select(*[F.col(c).alias(f"_by_{c}") for c in by], "_blocks")
    joined = rows.join(named, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]) if by else rows.crossJoin(F.broadcast(named))  # one row
    dealt = joined.withColumn(block, F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int"))
    return dealt.withColumn(place, F.row_number().over(Window.partitionBy(*by, block).orderBy(key)) - 1).drop("_blocks", *[f"_by_{c}" for c in by])


def pair_products(values: DataFrame, cells: DataFrame, by: list[str], pairs: DataFrame | None = None) -> DataFrame:
    """``by``, gene_1, gene_2, prod: the sum over the cells of a group of v of gene_1 times v of gene_2.

    ``values`` (cell_id, gene_id, v) has one value at most for each cell and gene, ``cells`` (cell_id, by) the
    group of each. With ``pairs`` (gene_1, gene_2) the listed ones, where any cell has both or not, else each
    unordered pair of genes once, a gene with itself too. Pairs that no cell of a group has together are
    left out, or have 0. The work is that of the tiles which hold a pair.
    """
    kind = values.schema["gene_id"].dataType
    genes = materialize(_placed(values.select("gene_id").distinct(), "gene_id", [], FEATURES, "gb", "gi"))
    placed = materialize(_placed(cells.select("cell_id", *by), "cell_id", by, CELLS, "cb", "ci"))
    entries = values.join(placed, "cell_id").join(genes, "gene_id")
    packed = materialize(entries.groupBy(*by, "cb", "gb").agg(F.collect_list(F.struct("ci", "gi", F.col("v").cast("double").alias("v"))).alias("cells")))

    side = lambda i: genes.select(F.col("gene_id").alias(f"gene_{i}"), F.col("gb").alias(f"g{i}"), F.col("gi").alias(f"p{i}"))
    if pairs is None:
        blocks = genes.select("gb").distinct()
        tiles = blocks.select(F.col("gb").alias("g1")).join(blocks.select(F.col("gb").alias("g2")), F.col("g1") <= F.col("g2"))
        wanted = tiles.withColumn("wanted", F.lit(None).cast("array<struct<p1:int,p2:int>>"))
    else:
        listed = pairs.select("gene_1", "gene_2").distinct().join(side(1), "gene_1").join(side(2), "gene_2")
        wanted = listed.groupBy("g1", "g2").agg(F.collect_list(F.struct("p1", "p2")).alias("wanted"))
    wanted = materialize(wanted)

    of = lambda i: packed.select(*[F.col(c).alias(f"_{c}_{i}") for c in (*by, "cb")], F.col("gb").alias(f"g{i}"), F.col("cells").alias(f"cells_{i}"))
    same = [F.col(f"_{c}_1").eqNullSafe(F.col(f"_{c}_2")) for c in (*by, "cb")]
    met = of(1).join(wanted.select("g1", F.col("g2").alias("_g2")), "g1").join(of(2), [F.col("_g2") == F.col("g2"), *same])
    met = met.select(*[F.col(f"_{c}_1").alias(c) for c in by], "g1", "g2", "cells_1", "cells_2")
    keys = [*by, "g1", "g2"]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                one, two = batch.column("cells_1")[i], batch.column("cells_2")[i]
                rows = 1 + max(int(c.values.field("ci").to_numpy().max()) for c in (one, two))
                part = _dense(one, rows).T @ _dense(two, rows)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, 1) for c in keys], pa.array([part.shape[1]], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=[*keys, "width", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the parts of each tile, which come one after the other."""
        held: tuple | None = None

        def done() -> pa.RecordBatch:
            row, total = held
            return pa.RecordBatch.from_arrays([*row, pa.array([total.shape[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=[*keys, "width", "part"])

        for batch in batches:
            for i in range(len(batch)):
                row = [batch.column(c).slice(i, 1) for c in keys]
                part = np.frombuffer(batch.column("part")[i].as_buffer(), dtype=float).reshape(-1, batch.column("width")[i].as_py())
                if held is not None and all(x.equals(y) for x, y in zip(held[0], row)):
                    total = held[1]
                    grown = np.zeros(np.maximum(total.shape, part.shape))
                    grown[: total.shape[0], : total.shape[1]] = total
                    grown[: part.shape[0], : part.shape[1]] += part
                    held = row, grown
                else:
                    if held is not None:
                        yield done()
                    held = row, part
        if held is not None:
            yield done()

    def listed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each pair of a tile."""
        for batch in batches:
            for i in range(len(batch)):
                part = np.frombuffer(batch.column("part")[i].as_buffer(), dtype=float).reshape(-1, batch.column("width")[i].as_py())
                one, two = (batch.column(c)[i].values for c in ("names_1", "names_2"))
                if batch.column("wanted")[i].is_valid:
                    x, y = (batch.column("wanted")[i].values.field(c).to_numpy() for c in ("p1", "p2"))
                    inside = (x < part.shape[0]) & (y < part.shape[1])  # beyond it no cell has the gene
                    x, y = x[inside], y[inside]
                else:
                    x, y = (z.ravel() for z in np.indices(part.shape))
                names_1, names_2 = one.take(pa.array(x)), two.take(pa.array(y))
                prod = pa.array(part[x, y])
                if not batch.column("wanted")[i].is_valid and batch.column("g1")[i].equals(batch.column("g2")[i]):
                    keep = pa.array(x <= y)
                    names_1, names_2, prod = names_1.filter(keep), names_2.filter(keep), prod.filter(keep)
                where = pa.array(np.full(len(prod), i))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(where) for c in by], names_1, names_2, prod], names=[*by, "gene_1", "gene_2", "prod"])

    own = [met.schema[c] for c in keys]
    parts = T.StructType([*own, T.StructField("width", T.IntegerType()), T.StructField("part", T.BinaryType())])
    tasks = max(values.sparkSession.sparkContext.defaultParallelism, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sums = met.mapInArrow(multiply, parts).repartition(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(add, parts)
    names = genes.groupBy("gb").agg(F.sort_array(F.collect_list(F.struct("gi", "gene_id"))).alias("n"))
    of_block = lambda i: names.select(F.col("gb").alias(f"g{i}"), F.transform("n", lambda g: g["gene_id"]).alias(f"names_{i}"))
    named = sums.join(wanted, ["g1", "g2"]).join(of_block(1), "g1").join(of_block(2), "g2")
    out = T.StructType([*own[:-2], T.StructField("gene_1", kind), T.StructField("gene_2", kind), T.StructField("prod", T.DoubleType())])
    return named.select(*keys, "width", "part", "wanted", "names_1", "names_2").mapInArrow(listed_rows, out)
