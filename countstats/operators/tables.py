"""Pairs and triples, lookups, designs and edge lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Results of all pairs or triples have so many rows at most.
MOST_PAIRS = 2_000_000_000
#: Pairs that a task lists, about.
PAIRS_OF_TASK = 1 << 24


def _refuse(rows: int) -> None:
    if rows > MOST_PAIRS:
        raise ValueError(f"{rows} pairs; the most is {MOST_PAIRS}, so list the wanted ones instead")


def product_pairs(a: DataFrame, b: DataFrame, key: str = "gene_id", exclude_same: bool = True, refuse: bool = True) -> DataFrame:
    """J3. Every (gene_1 of a, gene_2 of b); more than MOST_PAIRS are an error unless all of them are wanted
    (``refuse`` false). They are made one by one, by so many tasks that each lists about PAIRS_OF_TASK."""
    rows = a.count() * b.count()
    if refuse:
        _refuse(rows)
    first, second = a.select(F.col(key).alias("gene_1")), b.select(F.col(key).alias("gene_2"))
    if rows > PAIRS_OF_TASK:
        first = first.repartition(-(-rows // PAIRS_OF_TASK))
    pairs = first.crossJoin(second)
    return pairs.filter("gene_1 <> gene_2") if exclude_same else pairs


def unordered_pairs(a: DataFrame, key: str = "gene_id") -> DataFrame:
    """J3. gene_1 < gene_2; more than MOST_PAIRS are an error."""
    n = a.count()
    _refuse(n * (n - 1) // 2)
    return a.select(F.col(key).alias("gene_1")).join(a.select(F.col(key).alias("gene_2")), F.col("gene_1") < F.col("gene_2"))


def regulator_triples(regulators: DataFrame, target_snps: DataFrame) -> DataFrame:
    """J4. (regulator, target, snp): each regulator with each target's SNPs, but not with itself; more
    than MOST_PAIRS are an error."""
    _refuse(regulators.count() * target_snps.count())
    return target_snps.crossJoin(regulators.select("regulator")).filter("regulator <> target").select("regulator", "target", "snp")


def two_role_lookup(pairs: DataFrame, values: DataFrame, first: str, second: str, key: str, value: str) -> DataFrame:
    """J5. ``pairs`` with the value of either role and their difference."""
    role = lambda c: values.select(F.col(key).alias(c), F.col(value).alias(f"{c}_{value}"))
    joined = pairs.join(role(first), first, "left").join(role(second), second, "left")
    return joined.withColumn("difference", F.col(f"{first}_{value}") - F.col(f"{second}_{value}"))


def outer_merge(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """J1. One wide row for each key; the other columns carry the table's name."""
    named = [t.select(key, *[F.col(c).alias(f"{c}_{n}") for c in t.columns if c != key]) for n, t in tables.items()]
    return reduce(lambda a, b: a.join(b, key, "full"), named)


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """T1. The first ``k`` rows of each group with their ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def with_group_mean(df: DataFrame, by: list[str], col: str, out: str) -> DataFrame:
    """A3. A group's mean beside each of its rows, by an aggregate that joins back."""
    return df.join(df.groupBy(*by).agg(F.avg(col).alias(out)), by)


MOST_LEVELS = 1000


def one_hot(df: DataFrame, col: str, levels: list[str] | None = None, drop_first: bool = True, centre: bool = False) -> DataFrame:
    """X2. A 0/1 column for each level, but for the first if ``drop_first``; ``centre`` takes the mean
    off. Without ``levels`` the distinct ones are collected, a column each: more than MOST_LEVELS are
    an error."""
    if levels is None:
        found = df.select(col).distinct().limit(MOST_LEVELS + 1).collect()
        if len(found) > MOST_LEVELS:
            raise ValueError(f"{col} has more than {MOST_LEVELS} levels")
        levels = sorted((r[0] for r in found), key=lambda v: (v is not None, v))
    used = levels[1:] if drop_first else levels
    out = df.withColumns({f"{col}_{v}": F.when(F.col(col) == v, 1.0).otherwise(0.0) for v in used})
    if not centre or not used:
        return out
    means = out.agg(*[F.avg(F.col(f"`{col}_{v}`")).alias(f"_m{i}") for i, v in enumerate(used)])
    out = out.crossJoin(F.broadcast(means))
    return out.withColumns({f"{col}_{v}": F.col(f"`{col}_{v}`") - F.col(f"_m{i}") for i, v in enumerate(used)}).drop(*[f"_m{i}" for i in range(len(used))])


def with_interactions(df: DataFrame, a: list[str], b: list[str]) -> DataFrame:
    """X2. Products of every two columns of the lists, and a constant."""
    return df.withColumns({f"{x}:{y}": F.col(f"`{x}`") * F.col(f"`{y}`") for x in a for y in b} | {"const": F.lit(1.0)})


def edge_list(pairs: DataFrame, weight: str, threshold: float) -> DataFrame:
    """X3. gene_1, gene_2, weight of pairs at or above the threshold in size."""
    return pairs.filter(F.abs(weight) >= threshold).select("gene_1", "gene_2", F.col(weight).alias("weight"))


def node_degree(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("gene_1", "gene_2")).alias("gene_id")).groupBy("gene_id").agg(F.count("*").alias("degree"))
