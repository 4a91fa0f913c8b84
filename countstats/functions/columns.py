"""Column expressions that several operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import materialize


def as_null(c: Column) -> Column:
    """NaN and infinities as null: an estimate that is not valid."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def argmax_column(names: list[str]) -> Column:
    """Name of the column with the largest value, the first of equals; null if all are null."""
    best = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    return reduce(lambda rest, n: F.when(F.col(n) == best, n).otherwise(rest), reversed(names), F.lit(None).cast("string"))


def running_before(rows: DataFrame, by: list[str], order: list[Column | str], weights: dict[str, Column]) -> DataFrame:
    """``rows`` with a column for each of ``weights``: the sum over the rows of the same ``by`` that come before in
    ``order``. Ranges of the order are summed in parallel and then shifted, so no task sorts a whole
    group; rows that tie in all of ``order`` share a range."""
    # Written, as the ranges come from a sample that another run need not draw alike.
    ranged = materialize(rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy(*by, "_range").agg(*[F.sum(w).alias(f"_sum_{i}") for i, w in enumerate(weights.values())])
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(f"_sum_{i}").over(earlier), F.lit(0)).alias(f"_shift_{i}") for i in range(len(weights))]
    shift = sums.select(*[F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)], F.col("_range").alias("_range_2"), *before)
    own = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumns({out: F.coalesce(F.sum(w).over(own), F.lit(0)) for out, w in weights.items()})
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_by_{i}")) for i, c in enumerate(by)], F.col("_range") == F.col("_range_2"))
    return summed.join(shift, same).select(*rows.columns, *[(F.col(out) + F.col(f"_shift_{i}")).alias(out) for i, out in enumerate(weights)])


def average_rank(df: DataFrame, by: list[str], col: str, out: str) -> DataFrame:
    """``df`` with ``out``: ranks from 1 in which equal values share the mean of their places. Values are
    counted first, and only distinct ones are put in order."""
    counts = df.groupBy(*by, col).agg(F.count("*").alias("_n"))
    ranked = running_before(counts, by, [col], {"_before": F.col("_n")})
    ranked = ranked.select(*[F.col(c).alias(f"_by_{c}") for c in (*by, col)], (F.col("_before") + (F.col("_n") + 1) / 2.0).alias(out))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in (*by, col)])
    return df.join(ranked, same).select(*df.columns, out)


def quantiles(df: DataFrame, by: list[str], col: str, shares: list[float], names: list[str]) -> DataFrame:
    """``by`` and a column of each of ``names``: interpolated quantiles at ``shares`` of the values of
    ``col`` that are not null. Values are counted first; the places come from running counts."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(*by, F.col(col).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    placed = running_before(counts, by, ["_v"], {"_before": F.col("_n")})
    totals = placed.groupBy(*by).agg(F.max(F.col("_before") + F.col("_n")).alias("_all"))
    placed = placed.join(totals, by) if by else placed.crossJoin(F.broadcast(totals))  # one row
    at = lambda share, up: F.least(F.floor((F.col("_all") - 1) * share) + up, F.col("_all") - 1)
    value = lambda share, up: F.min(F.when(F.col("_before") + F.col("_n") > at(share, up), F.col("_v")))
    ends = placed.groupBy(*by).agg(F.max("_all").alias("_all"), *[value(share, up).alias(f"_{i}_{up}") for i, share in enumerate(shares) for up in (0, 1)])
    rest = lambda share: (F.col("_all") - 1) * share - F.floor((F.col("_all") - 1) * share)
    return ends.select(*by, *[(F.col(f"_{i}_0") + rest(share) * (F.col(f"_{i}_1") - F.col(f"_{i}_0"))).alias(name) for i, (share, name) in enumerate(zip(shares, names))])


def quadratic_fit(rows: DataFrame, by: list[str], x: Column, y: Column) -> DataFrame:
    """``by``, center, c0, c1, c2: least squares of y on 1, x - center, (x - center)^2 for each group.

    Power sums of x around its mean give a 3 x 3 system, solved by Cramer's rule in columns. With
    fewer than three different x the coefficients are null.
    """
    points = rows.select(*by, x.alias("_x"), y.alias("_y")).filter("_x is not null and _y is not null")
    centers = points.groupBy(*by).agg(F.avg("_x").alias("center"))
    joined = points.join(centers, by) if by else points.crossJoin(F.broadcast(centers))
    z = F.col("_x") - F.col("center")
    sums = joined.groupBy(*by, "center").agg(*[F.sum(F.pow(z, k)).alias(f"s{k}") for k in range(5)], *[F.sum(F.pow(z, k) * F.col("_y")).alias(f"t{k}") for k in range(3)])
    s = [F.col(f"s{k}") for k in range(5)]
    t = [F.col(f"t{k}") for k in range(3)]

    def det(a: list[list[Column]]) -> Column:
        return a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])

    normal = [[s[i + j] for j in range(3)] for i in range(3)]
    whole = det(normal)
    solved = [det([[t[i] if j == k else normal[i][j] for j in range(3)] for i in range(3)]) for k in range(3)]
    return sums.select(*by, "center", *[F.when(F.abs(whole) > 1e-12, c / whole).alias(f"c{k}") for k, c in enumerate(solved)])
