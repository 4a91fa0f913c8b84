"""Mean, variance, covariance and correlation of counts by group, corrected for incomplete capture.

``cells`` has cell_id, grp, q and size_factor; cells of size factor 0 hold nothing and are left out.
Zeros are not stored: they matter only through the number of cells, which comes from ``cells``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_null, clip
from . import cube
from .products import pair_products

GOOD_TURING = 13


@dataclass(frozen=True)
class EstimatorSpec:
    """D1. ``point`` makes (mean, var) columns from the sums of ``sums_by_group``; ``boot`` makes them
    from values x, weights (rows x draws), inverse size factors, cells n and capture rate q; without
    it there are point values only. ``cov`` makes a column from the sums of ``pair_sums``, ``cov_boot``
    its values from x1, x2, weights, inverse size factors, n and q; without them there are no pairs.
    ``absolute`` sets size factors to 1, ``zeros_alike`` tells that ``boot`` and ``cov_boot`` see nothing of the size
    factors of zeros (then these are drawn together), ``fitted`` tells if variances are set against the mean, and
    ``corrected`` replaces the counts (see ``good_turing_counts``)."""

    point: Callable[[], tuple[Column, Column]]
    boot: Callable[[np.ndarray, np.ndarray, np.ndarray, int, float], tuple[np.ndarray, np.ndarray]] | None = None
    absolute: bool = False
    cov: Callable[[], Column] | None = None
    cov_boot: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, float], np.ndarray] | None = None
    fitted: bool = True
    zeros_alike: bool = False
    corrected: Callable[[DataFrame, DataFrame, list[str]], DataFrame] | None = None


def _hyper(q: Column | float) -> tuple[Column, Column]:
    mean = F.col("sx") / F.col("n_obs")
    return mean, (F.col("sxx") - (1 - q) * F.col("sx2")) / F.col("n_obs") - mean * mean


def _hyper_cov(q: Column | float) -> Column:
    n = F.col("n_obs")
    own = F.when(F.col("gene_1") == F.col("gene_2"), (1 - q) * F.col("sx2") / n).otherwise(0.0)
    return F.col("prod") / n - own - F.col("sx_1") / n * F.col("sx_2") / n


def _hyper_boot(x, w, inverse, n, q):
    mean = (x * inverse) @ w / n
    return mean, ((x * x - (1 - q) * x) * inverse**2) @ w / n - mean**2


def _hyper_cov_boot(x1, x2, w, inverse, n, q):
    return (x1 * x2 * inverse**2) @ w / n - ((x1 * inverse) @ w / n) * ((x2 * inverse) @ w / n)


def _with_rate(q: Callable[[], Column] | float, absolute: bool = False) -> EstimatorSpec:
    """The hypergeometric estimators at the groups' capture rate, or at a fixed one."""
    rate = q if callable(q) else lambda: F.lit(q)
    boot = _hyper_boot if callable(q) else lambda x, w, inverse, n, _: _hyper_boot(x, w, inverse, n, q)
    return EstimatorSpec(lambda: _hyper(rate()), boot, absolute, lambda: _hyper_cov(rate()), _hyper_cov_boot, zeros_alike=True)


def _mean_boot(x, w, inverse, n, q):
    mean = (x * inverse) @ w / n + 1
    return mean, np.full(mean.shape, 10.0)


def _bulk_boot(x, w, inverse, n, q):
    mean = (x @ w + 1) / ((1 / inverse) @ w)
    return mean, np.full(mean.shape, 10.0)


def good_turing_counts(counts: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    """(cell_id, gene_id, x, value): counts r below 13 become (r + 1) f(r+1) / f(r), with f(r) the mean
    number of genes with count r over the group's cells; larger ones stay, zeros are 0."""
    keyed = cells.filter("size_factor > 0").select("cell_id", *by)
    rows = counts.filter("x <> 0").join(keyed, "cell_id")
    freq = rows.filter(F.col("x") <= GOOD_TURING).groupBy(*by, "x").agg(F.count("*").alias("f"))
    after = freq.select(*by, (F.col("x") - 1).alias("x"), F.col("f").alias("g"))
    # The number of cells divides both frequencies and falls out of their ratio.
    fixed = freq.join(after, [*by, "x"], "left").filter(F.col("x") < GOOD_TURING).select(*by, "x", ((F.col("x") + 1) * F.coalesce("g", F.lit(0)) / F.col("f")).alias("fixed"))
    mended = rows.join(fixed, [*by, "x"], "left")
    return mended.select("cell_id", "gene_id", "x", F.when(F.col("x") < GOOD_TURING, F.col("fixed")).otherwise(F.col("x")).cast("double").alias("value"))


def _own_rate() -> Column:
    return F.col("q")


def _ten() -> Column:
    return F.lit(10.0)


ESTIMATORS: dict[str, EstimatorSpec] = {
    "hyper_relative": _with_rate(_own_rate),
    "poi_relative": _with_rate(0.0),
    "hyper_absolute": _with_rate(_own_rate, absolute=True),
    "poi_absolute": _with_rate(0.0, absolute=True),
    "naive": _with_rate(1.0),
    "mean_only": EstimatorSpec(lambda: (F.col("sx") / F.col("n_obs") + 1, _ten()), _mean_boot, fitted=False, zeros_alike=True),
    "pseudobulk": EstimatorSpec(lambda: ((F.col("total") + 1) / (F.col("ss") + 1), _ten()), _bulk_boot, fitted=False),
    "good_mean_only": EstimatorSpec(lambda: (F.col("sx") / F.col("n_obs"), _ten()), fitted=False, corrected=good_turing_counts),
}


def get_estimator(kind: str | EstimatorSpec) -> EstimatorSpec:
    if isinstance(kind, EstimatorSpec):
        return kind
    if kind not in ESTIMATORS:
        raise ValueError(f"no estimator {kind!r}; there are {sorted(ESTIMATORS)}")
    return ESTIMATORS[kind]


def group_sizes(cells: DataFrame, by: list[str]) -> DataFrame:
    """``by``, n_obs, q, ss: cells, mean capture rate and sum of size factors of each group."""
    return cells.filter("size_factor > 0").groupBy(*by).agg(F.count("*").alias("n_obs"), F.avg("q").alias("q"), F.sum("size_factor").alias("ss"))


def sums_by_group(counts: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    """Sufficient statistics of each (group, gene) that is counted, beside the group's sizes. A column
    ``value`` of counts stands for x in sx, sx2 and sxx."""
    keyed = cells.filter("size_factor > 0").select("cell_id", "size_factor", *by)
    x, s = F.col("value" if "value" in counts.columns else "x").cast("double"), F.col("size_factor")
    sums = counts.join(keyed, "cell_id").groupBy(*by, "gene_id").agg(F.sum(x / s).alias("sx"), F.sum(x / (s * s)).alias("sx2"), F.sum(x * x / (s * s)).alias("sxx"), F.sum(F.col("x").cast("double")).alias("total"), F.max("x").alias("raw_max"), F.count_if(F.col("x") != 0).alias("nnz"))
    sizes = group_sizes(cells, by)
    return sums.join(sizes, by) if by else sums.crossJoin(F.broadcast(sizes))  # one row


def moments(counts: DataFrame, cells: DataFrame, by: list[str] | None = None, kind: str | EstimatorSpec = "hyper_relative") -> DataFrame:
    """E1-E6. ``by``, gene_id, n_obs, mean, var, raw_mean, raw_max, nnz for each counted gene."""
    by = ["grp"] if by is None else by
    spec = get_estimator(kind)
    mean, var = spec.point()
    used = spec.corrected(counts, cells, by) if spec.corrected else counts
    return sums_by_group(used, cells, by).select(*by, "gene_id", "n_obs", mean.alias("mean"), var.alias("var"), (F.col("total") / F.col("n_obs")).alias("raw_mean"), "raw_max", "nnz", "q")


def good_turing_mean(counts: DataFrame, cells: DataFrame, genes: DataFrame, by: list[str]) -> DataFrame:
    """E5. ``by``, gene_id, mean of ``good_turing_counts`` over size factors, with counts of ``genes`` only."""
    some = counts.join(genes.select("gene_id"), "gene_id", "left_semi")
    return moments(some.filter("x <> 0"), cells, by, "good_mean_only").select(*by, "gene_id", "mean")


def pair_sums(counts: DataFrame, cells: DataFrame, pairs: DataFrame, by: list[str]) -> DataFrame:
    """``by``, gene_1, gene_2, n_obs, q, prod (sum of products of x / s), sx_1, sx_2 (sums of x / s) and
    sx2 (sum of x / s^2 of gene_1) for every listed pair and group. Counts are first cut down to the
    genes of the pairs; a pair that no cell has together has a product of 0."""
    listed = pairs.select("gene_1", "gene_2").distinct()
    involved = listed.select(F.col("gene_1").alias("gene_id")).union(listed.select("gene_2")).distinct()
    some = counts.join(involved, "gene_id", "left_semi")
    products = _products(some, cells, by, listed)

    sums = sums_by_group(some, cells, by).select(*by, "gene_id", "sx", "sx2")
    one = lambda i: sums.select(*by, F.col("gene_id").alias(f"gene_{i}"), F.col("sx").alias(f"sx_{i}"), *([F.col("sx2")] if i == 1 else []))
    out = group_sizes(cells, by).crossJoin(listed).join(one(1), [*by, "gene_1"]).join(one(2), [*by, "gene_2"]).join(products, [*by, "gene_1", "gene_2"], "left")
    return out.withColumn("prod", F.coalesce("prod", F.lit(0.0)))


def _products(counts: DataFrame, cells: DataFrame, by: list[str], pairs: DataFrame | None = None) -> DataFrame:
    """Sums of products of x / s (see ``products.pair_products``)."""
    keyed = cells.filter("size_factor > 0")
    values = counts.filter("x <> 0").join(keyed.select("cell_id", "size_factor"), "cell_id").select("cell_id", "gene_id", (F.col("x") / F.col("size_factor")).alias("v"))
    return pair_products(values, keyed.select("cell_id", *by), by, pairs)


def pair_covariance(counts: DataFrame, cells: DataFrame, pairs: DataFrame, by: list[str] | None = None, kind: str | EstimatorSpec = "hyper_relative") -> DataFrame:
    """E6-E8. ``by``, gene_1, gene_2, n_obs, cov for every listed pair and group."""
    by = ["grp"] if by is None else by
    spec = get_estimator(kind)
    if spec.cov is None:
        raise ValueError(f"{kind if isinstance(kind, str) else 'this estimator'} has no covariance")
    return pair_sums(counts, cells, pairs, by).select(*by, "gene_1", "gene_2", "n_obs", spec.cov().alias("cov"))


def correlation(cov: Column, var_1: Column, var_2: Column) -> Column:
    """E9. Null unless both variances are positive; clipped to [-1, 1]."""
    return F.when((var_1 > 0) & (var_2 > 0), clip(cov / F.sqrt(var_1 * var_2), -1.0, 1.0))


def pair_moments(counts: DataFrame, cells: DataFrame, pairs: DataFrame, one: DataFrame, by: list[str] | None = None, kind: str | EstimatorSpec = "hyper_relative") -> DataFrame:
    """E12. Covariance and correlation of listed pairs with the variances of ``one`` (see moments)."""
    by = ["grp"] if by is None else by
    var = lambda i: one.select(*by, F.col("gene_id").alias(f"gene_{i}"), F.col("var").alias(f"var_{i}"))
    joined = pair_covariance(counts, cells, pairs, by, kind).join(var(1), [*by, "gene_1"]).join(var(2), [*by, "gene_2"])
    return joined.withColumn("corr", correlation(F.col("cov"), F.col("var_1"), F.col("var_2")))


def correlation_matrix(counts: DataFrame, cells: DataFrame, one: DataFrame, genes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """E10. ``by``, gene_1, gene_2, corr for all pairs of ``genes`` that have moments in ``one``, both ways round. Beyond
    1.05 a correlation is null, within it is clipped. Products come from tiles of genes and cells; the
    result grows with the square of the genes, the work before it with tiles."""
    by = ["grp"] if by is None else by
    some = counts.join(genes.select("gene_id"), "gene_id", "left_semi")
    sums = sums_by_group(some, cells, by).select(*by, "gene_id", "sx", "sx2", "n_obs", "q").join(one.select(*by, "gene_id", "var"), [*by, "gene_id"])
    side = lambda i, *more: sums.select(*by, F.col("gene_id").alias(f"gene_{i}"), F.col("sx").alias(f"sx_{i}"), F.col("var").alias(f"var_{i}"), *more)
    found = _products(some, cells, by).join(side(1, "sx2", "n_obs", "q"), [*by, "gene_1"]).join(side(2), [*by, "gene_2"])
    cov = _hyper_cov(F.col("q"))
    raw = F.when((F.col("var_1") > 0) & (F.col("var_2") > 0), cov / F.sqrt(F.col("var_1") * F.col("var_2")))
    found = found.select(*by, "gene_1", "gene_2", F.when(F.abs(raw) < 1.05, clip(raw, -1.0, 1.0)).alias("corr"))
    ways = F.when(F.col("gene_1") == F.col("gene_2"), F.array(F.struct("gene_1", "gene_2"))).otherwise(F.array(F.struct("gene_1", "gene_2"), F.struct(F.col("gene_2").alias("gene_1"), F.col("gene_1").alias("gene_2"))))
    return found.select(*by, F.explode(ways).alias("_way"), "corr").select(*by, "_way.gene_1", "_way.gene_2", "corr")


def pseudobulk_table(counts: DataFrame, cells: DataFrame, by: list[str], stat: str = "sum") -> DataFrame:
    """E13. ``by``, gene_id, value: the sum of x or ln(1 + mean of x), 0 where a gene isn't counted."""
    keyed = cells.select("cell_id", *by)
    groups = keyed.groupBy(*by).agg(F.count("*").alias("n"))
    sums = counts.join(keyed, "cell_id").groupBy(*by, "gene_id").agg(F.sum("x").alias("s"))
    genes = counts.select("gene_id").distinct()
    full = groups.crossJoin(genes).join(sums, [*by, "gene_id"], "left")
    s = F.coalesce("s", F.lit(0))
    return full.select(*by, "gene_id", (s.cast("double") if stat == "sum" else F.log1p(s / F.col("n"))).alias("value"))


def latent_moments(counts: DataFrame, cells: DataFrame, q: float, min_mean: float = 0.0) -> DataFrame:
    """E14. gene_id, z_mean, z_var of the counts before capture: from E1 with total size factors and
    the first two moments of total / q over the cells."""
    fixed = cells.withColumn("q", F.lit(q))
    one = moments(counts, fixed, [], "hyper_relative").filter(F.col("raw_mean") > min_mean)
    size = fixed.filter("size_factor > 0").agg(F.avg(F.col("size_factor") / q).alias("n1"), F.avg(F.pow(F.col("size_factor") / q, 2)).alias("n2"))
    z_mean = F.col("mean") * F.col("n1")
    z_var = (F.col("var") + F.col("mean") ** 2) * F.col("n2") - F.col("mean") ** 2 * F.col("n1") ** 2
    return one.crossJoin(F.broadcast(size)).select("gene_id", z_mean.alias("z_mean"), z_var.alias("z_var"))


def estimator_cube(counts: DataFrame, cells: DataFrame, dims: list[str]) -> DataFrame:
    """E15. ``dims``, gene_id, nnz, n_obs, min, max, sum, mean, sem. Size factors are the cells' totals
    over all genes; min and max are of counts that are not 0; sem is sd(x / s) / sqrt(n). See ``cube`` for
    one that grows by batches."""
    totals = cube.cell_totals(counts)
    return cube.finished(cube.states(counts, cells, totals, dims), cube.group_sizes(cells, totals, dims), dims)


def group_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """E16. Size of each group and its share of all rows."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("n"))
    return sizes.crossJoin(F.broadcast(sizes.agg(F.sum("n").alias("_all")))).withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def marker_matrix(counts: DataFrame, cells: DataFrame, genes: list[str], by: str) -> DataFrame:
    """E17. One row for each cluster, a column for each gene: its mean over all the cluster's cells,
    divided by the largest of these."""
    keyed = cells.select("cell_id", by)
    n = keyed.groupBy(by).agg(F.count("*").alias("n"))
    sums = counts.filter(F.col("gene_id").isin(genes)).join(keyed, "cell_id").groupBy(by).pivot("gene_id", genes).agg(F.sum("x"))
    means = n.join(sums, by, "left").select(by, *[(F.coalesce(F.col(f"`{g}`"), F.lit(0)) / F.col("n")).alias(g) for g in genes])
    top = means.agg(*[F.max(F.col(f"`{g}`")).alias(f"_top_{i}") for i, g in enumerate(genes)])
    return means.crossJoin(F.broadcast(top)).select(by, *[as_null(F.try_divide(F.col(f"`{g}`"), F.col(f"_top_{i}"))).alias(g) for i, g in enumerate(genes)])
