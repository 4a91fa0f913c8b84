"""Draws and regressions as a stream: segments in, sums of coefficients out.

A segment is what one gene (or pair) has in one group: its compressed rows and the group's parameters. A worker
goes through sorted batches of segments, hundreds of genes at a time. Where the draws of all groups of a gene
are too many to be held by one task, they are written as blocks first, and each block of draws is regressed on
its own; sums by UNIT of draws are merged afterwards, so that both ways give the same numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import special
from . import bootstrap

#: Most values (groups x draws x statistics) of one gene that a task holds at once.
HELD = 4_000_000


@dataclass(frozen=True)
class Design:
    """The groups in order, and the columns of treatments (groups x treatments) and covariates."""

    groups: list[str]
    treatments: list[str]
    covariates: list[str]
    treatment_values: np.ndarray
    covariate_values: np.ndarray


@dataclass(frozen=True)
class Plan:
    """What a stream has to do. ``draw`` makes the draws (statistics x draws) and the observed values of a
    segment, or None if the group has no place in the test."""

    keys: list[str]
    statistics: int
    draws: int
    draw: Callable[[dict], tuple[np.ndarray, np.ndarray] | None]
    design: Design
    picks: Callable[..., bootstrap.Picks] | None = None


def cells_of(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``keys``, grp and ``cells``: the compressed rows of each segment in a stated order, with the weights
    ``w`` of given draws if the rows have any."""
    columns = ["sf_bin", *values, "n", *(["w"] if "w" in rows.columns else [])]
    as_double = [F.col(c).cast("double").alias(c) if c in values else F.col(c) for c in columns]
    return rows.groupBy(*keys, "grp").agg(F.sort_array(F.collect_list(F.struct(*as_double))).alias("cells"))


def _segments(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch; compressed rows as arrays."""
    cells = batch.column("cells") if "cells" in batch.schema.names else None
    others = [c for c in batch.schema.names if c != "cells"]
    plain = {c: batch.column(c).to_pylist() for c in others}
    arrays, ends = {}, []
    if cells is not None:
        flat = cells.flatten()
        ends = np.cumsum([0, *[n or 0 for n in pc.list_value_length(cells).to_pylist()]]).tolist()
        for field in flat.type:
            column = flat.field(field.name)
            if field.name == "w":
                arrays["w"] = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))
            else:
                arrays[field.name] = column.to_numpy(zero_copy_only=False)
    for i in range(len(batch)):
        row = {c: plain[c][i] for c in others}
        yield row | {c: v[ends[i] : ends[i + 1]] for c, v in arrays.items()}


def _inverse(segment: dict, absolute: bool) -> np.ndarray:
    return np.ones(len(segment["n"])) if absolute else 1 / segment["sf_bin"].astype(float)


def drawn(segment: dict, values: tuple[str, ...], draws: int, statistic, rng: np.random.Generator, zeros_alike: bool, absolute: bool) -> tuple[np.ndarray, ...]:
    """``statistic`` (of values, weights, inverse size factors and the number of cells) for each draw: of
    given weights, if the segment has them, or of random ones."""
    n, inverse, x = segment["n"].astype(np.int64), _inverse(segment, absolute), [segment[c].astype(float) for c in values]
    total = int(n.sum())
    if "w" in segment:
        return statistic(*x, segment["w"][:, :draws], inverse, total)
    if zeros_alike:
        n, inverse, *x = bootstrap.alike(n, inverse, *x)
        n = n.astype(np.int64)
    return bootstrap.resample(rng, n, draws, lambda w: statistic(*x, w, inverse, total))


_SUMS = [T.StructField("statistic", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("observed", T.DoubleType()), T.StructField("n", T.ArrayType(T.LongType())), *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("mean", "m2")], T.StructField("beyond", T.ArrayType(T.LongType()))]


class _Gene:
    """What has come of one gene: its head (treatments and covariates of its own) and its groups' draws."""

    def __init__(self, plan: Plan, key: tuple):
        self.plan, self.key, self.head = plan, key, None
        self.groups: list[int] = []
        self.weights: list[float] = []
        self.observed: list[np.ndarray] = []
        self.drawn: list[np.ndarray] = []

    def add(self, group: int, weight: float, observed: np.ndarray, drawn_: np.ndarray) -> None:
        self.groups.append(group)
        self.weights.append(weight)
        self.observed.append(observed)
        self.drawn.append(drawn_)

    def rows(self, block: int, unit: int) -> list[tuple]:
        """A row for each test and statistic. Draws with a group that is not finite are left out."""
        plan, design = self.plan, self.plan.design
        txs, covs = (self.head or {}).get("txs"), (self.head or {}).get("covs")
        if txs is None:
            names, doses = design.treatments, design.treatment_values
        else:
            txs = sorted(txs, key=lambda t: t["tx"])
            names = [t["tx"] for t in txs]
            doses = np.array([t["dose"] for t in txs], dtype=float).reshape(len(txs), len(design.groups)).T
        nothing = [(*self.key, tx, s, block, None, [], [], [], []) for tx in names for s in range(plan.statistics)]
        if not self.groups or not names:
            return nothing
        own = [i for i, c in enumerate(design.covariates) if covs is None or c in covs]
        t, c, w = doses[self.groups], design.covariate_values[self.groups][:, own], np.array(self.weights)
        observed, values = np.array(self.observed), np.stack(self.drawn)  # groups x statistics (x draws)
        ok = np.isfinite(values).all(axis=(0, 1))
        if not np.isfinite(observed).all():
            return nothing
        out = []
        for s in range(plan.statistics):
            known = bootstrap.effects(observed[:, s : s + 1], t, c, w)[:, 0]
            found = bootstrap.effects(values[:, s], t, c, w, plan.picks(*self.key, s) if plan.picks else None, unit)
            found[:, ~ok] = np.nan
            sums = bootstrap.unit_sums(found, known)
            out += [(*self.key, tx, s, block, float(known[i]) if np.isfinite(known[i]) else None, *(x[i].tolist() for x in sums)) for i, tx in enumerate(names)]
        return out


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.StringType(): pa.string()}
    one = lambda kind: pa.list_(one(kind.elementType)) if isinstance(kind, T.ArrayType) else kinds[kind]
    return pa.schema([(f.name, one(f.dataType)) for f in schema])


def _whole(plan: Plan, schema: pa.Schema):
    """Draw and regress: segments sorted by gene, the head first."""
    places = {g: i for i, g in enumerate(plan.design.groups)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gene: _Gene | None = None
        for batch in batches:
            out: list[tuple] = []
            for segment in _segments(batch):
                key = tuple(segment[k] for k in plan.keys)
                if gene is None or gene.key != key:
                    out += gene.rows(0, 0) if gene else []
                    gene = _Gene(plan, key)
                if segment["grp"] is None:
                    gene.head = segment
                elif segment["grp"] in places and (found := plan.draw(segment)) is not None:
                    gene.add(places[segment["grp"]], float(segment["n_cells"]), *found)
            yield _table(out, schema)
        yield _table(gene.rows(0, 0) if gene else [], schema)

    return run


def _blocks(plan: Plan, width: int, schema: pa.Schema):
    """Draw only: a row for each segment and block of draws."""
    places = {g: i for i, g in enumerate(plan.design.groups)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for segment in _segments(batch):
                if segment["grp"] not in places or (found := plan.draw(segment)) is None:
                    continue
                observed, values = found
                key = tuple(segment[k] for k in plan.keys)
                for block in range(max(1, -(-plan.draws // width))):
                    part = values[:, block * width : (block + 1) * width]
                    out.append((*key, segment["grp"], block, float(segment["n_cells"]), observed.tolist(), part.ravel().tolist()))
                held += values.size
                if held > HELD // 8:
                    yield _table(out, schema)
                    out, held = [], 0
            yield _table(out, schema)

    return run


def _regressed(plan: Plan, width: int, schema: pa.Schema):
    """Regress only: blocks of draws sorted by gene and block, the head first."""
    places = {g: i for i, g in enumerate(plan.design.groups)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gene, at = None, 0
        for batch in batches:
            out: list[tuple] = []
            draws = batch.column("draws")
            flat, ends = draws.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *[n or 0 for n in pc.list_value_length(draws).to_pylist()]]).tolist()
            plain = {c: batch.column(c).to_pylist() for c in batch.schema.names if c != "draws"}
            for i in range(len(batch)):
                row = {c: v[i] for c, v in plain.items()}
                key = tuple(row[k] for k in plan.keys)
                if gene is None or (gene.key, at) != (key, row["block"]):
                    out += gene.rows(at, at * width // bootstrap.UNIT) if gene else []
                    gene, at = _Gene(plan, key), row["block"]
                if row["grp"] is None:
                    gene.head = row
                else:
                    gene.add(places[row["grp"]], row["n_cells"], np.array(row["observed"]), flat[ends[i] : ends[i + 1]].reshape(plan.statistics, -1).copy())
            yield _table(out, schema)
        yield _table(gene.rows(at, at * width // bootstrap.UNIT) if gene else [], schema)

    return run


def by_segment(segments: DataFrame, one: Callable[[dict], tuple | None], schema: str, keys: list[str]) -> DataFrame:
    """``one`` of each segment, a row or None, dealt to a stated number of tasks: the rows are few bytes but much work."""
    spark = segments.sparkSession
    made = _arrow(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _table([row for g in _segments(batch) if (row := one(g)) is not None], made)

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return segments.repartition(tasks, *keys).mapInArrow(run, schema)


def tests_by_stream(plan: Plan, segments: DataFrame, heads: DataFrame, block: int | None = None) -> DataFrame:
    """The sums (see ``bootstrap.unit_sums``) of every test: ``plan.keys``, tx, statistic, block, observed, n, mean, m2, beyond.

    ``segments`` has the keys, grp, n_cells, cells and what ``plan.draw`` reads; ``heads`` a row for each gene with
    txs, (tx, dose by group of the design) or null for the design's own, and covs, names of covariates or
    null for all. ``block`` forces blocks of so many draws, a multiple of UNIT.
    """
    spark, keys = segments.sparkSession, plan.keys
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = T.StructType([*[T.StructField(k, T.StringType()) for k in keys], T.StructField("tx", T.StringType()), *_SUMS])
    name = [F.col(k).cast("string").alias(k) for k in keys]
    segments, heads = segments.withColumns(dict(zip(keys, name))), heads.withColumns(dict(zip(keys, name)))
    of_gene = len(plan.design.groups) * plan.statistics
    if block is None and of_gene * (plan.draws + 1) <= HELD:
        rows = segments.unionByName(heads, allowMissingColumns=True).repartition(tasks, *keys).sortWithinPartitions(*keys, F.col("grp").asc_nulls_first())
        return rows.mapInArrow(_whole(plan, _arrow(schema)), schema)
    width = block or max(1, HELD // (2 * of_gene * bootstrap.UNIT)) * bootstrap.UNIT
    if width % bootstrap.UNIT:
        raise ValueError(f"a block must have a multiple of {bootstrap.UNIT} draws")
    made = T.StructType([*[T.StructField(k, T.StringType()) for k in keys], T.StructField("grp", T.StringType()), T.StructField("block", T.IntegerType()), T.StructField("n_cells", T.DoubleType()), T.StructField("observed", T.ArrayType(T.DoubleType())), T.StructField("draws", T.ArrayType(T.DoubleType()))])
    drawn_ = segments.repartition(tasks, *keys, "grp").mapInArrow(_blocks(plan, width, _arrow(made)), made)
    every = heads.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-plan.draws // width) - 1)))))
    rows = drawn_.unionByName(every, allowMissingColumns=True).repartition(tasks, *keys, "block").sortWithinPartitions(*keys, "block", F.col("grp").asc_nulls_first())
    return rows.mapInArrow(_regressed(plan, width, _arrow(schema)), schema)


def _merged(units: Column) -> Column:
    """n, mean, m2 and beyond of all units, merged in their order."""

    def merge(s: Column, u: Column) -> Column:
        n, gap = s["n"] + u["n"], u["mean"] - s["mean"]
        return F.when(u["n"] == 0, s).otherwise(F.struct(n.alias("n"), (s["mean"] + gap * u["n"] / n).alias("mean"), (s["m2"] + u["m2"] + gap * gap * s["n"] * u["n"] / n).alias("m2"), (s["beyond"] + u["beyond"]).alias("beyond")))

    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"), F.lit(0).cast("long").alias("beyond"))
    return F.aggregate(units, zero, merge)


def summarised(sums: DataFrame, keys: list[str], names: list[str], approx: str, observed_only: bool = False) -> DataFrame:
    """H7. ``keys``, tx and <name>_coef, <name>_se, <name>_pval for each statistic.

    The coefficient is the mean of the observed and all drawn ones, or the observed alone; the error is the
    spread of the drawn. The null is drawn minus observed: ``norm`` takes the tails of a normal of
    its mean and spread beyond +-|observed|, ``boot`` the share of it beyond. Null if draws don't differ.
    """
    if approx not in ("norm", "boot"):
        raise ValueError("approx must be 'norm' or 'boot'")
    part = F.struct("block", "observed", F.arrays_zip("n", "mean", "m2", "beyond").alias("units"))
    parts = sums.groupBy(*keys, "tx").agg(*[F.sort_array(F.collect_list(F.when(F.col("statistic") == i, part))).alias(f"_{i}") for i in range(len(names))])
    out = parts.select(*keys, "tx", *[c for i, name in enumerate(names) for c in (F.get(f"_{i}", F.lit(0))["observed"].alias(f"_{name}"), _merged(F.flatten(F.transform(f"_{i}", lambda p: p["units"]))).alias(f"_{name}_sums"))])
    columns = []
    for name in names:
        observed, s = F.col(f"_{name}"), F.col(f"_{name}_sums")
        sd, size, told = F.sqrt(s["m2"] / s["n"]), F.abs(observed), observed.isNotNull() & (s["n"] > 0)
        coef = observed if observed_only else (observed + s["mean"] * s["n"]) / (s["n"] + 1)
        differ = told & (sd > 0)
        tail = special.vectorised(lambda a, b: special.normal_sf(a) + special.normal_sf(b))
        shift = s["mean"] - observed
        p = F.when(differ, s["beyond"] / s["n"]) if approx == "boot" else tail(F.when(differ, (size - shift) / sd), F.when(differ, (size + shift) / sd))
        columns += [coef.alias(f"{name}_coef"), F.when(told, sd).alias(f"{name}_se"), p.alias(f"{name}_pval")]
    return out.select(*keys, "tx", *columns)
