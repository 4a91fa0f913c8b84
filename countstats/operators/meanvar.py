"""Mean-variance fits, residual variance, gene filters, trends and moment tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_null, average_rank, quadratic_fit, running_before
from ..functions.lineage import materialize


def gene_filters(one: DataFrame, groups: DataFrame, mean_threshold: float = 0.07, min_share: float = 0.7) -> DataFrame:
    """M1. gene_id, share: the share of all ``groups`` in which the raw mean is above the threshold and
    the variance positive; genes above ``min_share``. A group that lacks the gene counts as failing."""
    passing = (F.col("raw_mean") > mean_threshold) & (F.col("var") > 0)
    total = groups.agg(F.count("*").alias("_groups"))
    passed = one.groupBy("gene_id").agg(F.count_if(passing).alias("_pass"))
    return passed.crossJoin(F.broadcast(total)).select("gene_id", (F.col("_pass") / F.col("_groups")).alias("share")).filter(F.col("share") > min_share)


def fit_mean_variance(one: DataFrame, by: list[str] | None = None, least_max: int = 2) -> DataFrame:
    """M2. ``by``, center, c0, c1, c2 of ln var as a quadratic of ln mean, over genes whose mean and
    variance are positive and whose largest count is ``least_max`` at least."""
    by = ["grp"] if by is None else by
    good = one.filter(F.col("raw_max") >= least_max).filter("mean > 0 and var > 0")
    return quadratic_fit(good, by, F.log("mean"), F.log("var"))


def flat_fit(groups: DataFrame) -> DataFrame:
    """The fit that leaves variances as they are, for estimators without one."""
    return groups.select("grp", *[F.lit(0.0).alias(c) for c in ("center", "c0", "c1", "c2")])


def residual_variance(mean: Column, var: Column) -> Column:
    """M3. exp(ln var - fit at ln mean) from columns of ``fit_mean_variance``; null unless both are positive."""
    z = F.log(mean) - F.col("center")
    return F.when((mean > 0) & (var > 0), as_null(F.exp(F.log(var) - (F.col("c0") + F.col("c1") * z + F.col("c2") * z * z))))


def with_residual_variance(one: DataFrame, fit: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = ["grp"] if by is None else by
    joined = one.join(fit, by, "left") if by else one.crossJoin(F.broadcast(fit))
    return joined.withColumn("res_var", residual_variance(F.col("mean"), F.col("var"))).drop("center", "c0", "c1", "c2")


def least_variable_genes(one: DataFrame, trim_percent: float = 0.1, mean_threshold: float = 0.07) -> DataFrame:
    """S3. gene_id of genes whose residual variance over all cells is in the lowest ``trim_percent``
    (an interpolated quantile); genes of a raw mean below the threshold don't take part."""
    good = one.filter(F.col("raw_mean") >= mean_threshold)
    scored = with_residual_variance(good, fit_mean_variance(good, [], least_max=0), []).filter("res_var is not null")
    limit = scored.agg(F.percentile("res_var", F.lit(trim_percent)).alias("_limit"))
    return scored.crossJoin(F.broadcast(limit)).filter("res_var <= _limit").select("gene_id", "res_var")


def moments_1d(mom: DataFrame, groups: DataFrame, groupby: str | None = None) -> DataFrame:
    """M4. gene_id, key, log_mean, log_res_var: of each group, or with ``groupby`` (a label column, or
    'ALL') the cell-weighted mean of the logs over the groups in which they exist."""
    logs = mom.select("grp", "gene_id", "n_obs", F.when(F.col("mean") > 0, F.log("mean")).alias("m"), F.when(F.col("res_var") > 0, F.log("res_var")).alias("v"))
    if groupby is None:
        return logs.select("gene_id", F.col("grp").alias("key"), F.col("m").alias("log_mean"), F.col("v").alias("log_res_var"))
    key = F.lit("ALL") if groupby == "ALL" else F.col(groupby).cast("string")
    joined = logs.join(groups.select("grp", key.alias("key")), "grp")
    mean = lambda c: F.sum(F.col(c) * F.col("n_obs")) / F.sum(F.when(F.col(c).isNotNull(), F.col("n_obs")))
    return joined.groupBy("gene_id", "key").agg(mean("m").alias("log_mean"), mean("v").alias("log_res_var"))


def moments_2d(pair_mom: DataFrame, groups: DataFrame, groupby: str | None = None) -> DataFrame:
    """M5. The same for correlations; those that are not valid are left out."""
    if groupby is None:
        return pair_mom.select("gene_1", "gene_2", F.col("grp").alias("key"), "corr")
    key = F.lit("ALL") if groupby == "ALL" else F.col(groupby).cast("string")
    joined = pair_mom.filter("corr is not null").join(groups.select("grp", key.alias("key")), "grp")
    return joined.groupBy("gene_1", "gene_2", "key").agg((F.sum(F.col("corr") * F.col("n_obs")) / F.sum("n_obs")).alias("corr"))


def wide(table: DataFrame, keys: list[str], column: str, values: list[str], fields: list[str]) -> DataFrame:
    """One row for each ``keys``, columns ``<value>_<field>``."""
    return table.groupBy(*keys).pivot(column, values).agg(*[F.first(f).alias(f) for f in fields])


#: Rows of a group's order that one task takes.
CHUNK_ROWS = 100_000


def rolling_trend(df: DataFrame, x: str, y: str, width: int, by: list[str], key: str, alpha: float = 1.0) -> DataFrame:
    """M6. ``trend``: the mean of y over a row and the ``width - 1`` before it in order of x (ties by
    ``key``), and ``shrunk``: (1 - alpha) trend + alpha y. Each group is worked on in chunks of its order."""
    size = max(CHUNK_ROWS, width)
    numbered = running_before(df, by, [x, key], {"_number": F.lit(1)}).withColumn("_chunk", F.floor(F.col("_number") / size))
    # The last rows of a chunk go to the next one too, where they only serve as rows before.
    ends = numbered.filter(F.col("_number") % size >= size - (width - 1)).withColumn("_chunk", F.col("_chunk") + 1)
    both = numbered.withColumn("_own", F.lit(True)).union(ends.withColumn("_own", F.lit(False)))
    window = Window.partitionBy(*by, "_chunk").orderBy("_number").rowsBetween(-(width - 1), 0)
    found = both.withColumn("trend", F.avg(y).over(window)).filter("_own").select(*df.columns, "trend")
    return found.withColumn("shrunk", (1 - alpha) * F.col("trend") + alpha * F.col(y))


def local_slope(points: DataFrame, grid: DataFrame, x: str, y: str, bandwidth: float, cutoff: float = 3.0) -> DataFrame:
    """M7. at, slope: the slope of a linear fit around each grid point (at), weighted by a Gaussian
    kernel and cut off at ``cutoff`` bandwidths. Points meet grid points through bins of the cutoff."""
    reach = bandwidth * cutoff
    own = points.select(F.col(x).alias("_x"), F.col(y).alias("_y")).withColumn("_bin", F.floor(F.col("_x") / reach))
    near = grid.select("at", F.explode(F.array(*[F.floor(F.col("at") / reach) + d for d in (-1, 0, 1)])).alias("_bin"))
    gap = F.col("_x") - F.col("at")
    joined = own.join(near, "_bin").filter(F.abs(gap) <= reach)
    w = F.exp(-0.5 * (gap / bandwidth) ** 2)
    s = joined.groupBy("at").agg(F.sum(w).alias("w"), F.sum(w * gap).alias("wx"), F.sum(w * F.col("_y")).alias("wy"), F.sum(w * gap * gap).alias("wxx"), F.sum(w * gap * F.col("_y")).alias("wxy"))
    whole = F.col("w") * F.col("wxx") - F.col("wx") * F.col("wx")
    return s.select("at", F.when(whole > 1e-12, (F.col("w") * F.col("wxy") - F.col("wx") * F.col("wy")) / whole).alias("slope"))


def robust_linregress(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """M8. slope, intercept, r of finite pairs, and Spearman's rho from average ranks, by group."""
    good = df.select(*by, as_null(F.col(x)).alias("x"), as_null(F.col(y)).alias("y")).dropna()
    ranked = average_rank(average_rank(materialize(good), by, "x", "rx"), by, "y", "ry")
    return ranked.groupBy(*by).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.corr("x", "y").alias("r"), F.corr("rx", "ry").alias("spearman"))


def concordance(df: DataFrame, x: str, y: str, by: list[str], log: bool = False) -> DataFrame:
    """M9. Lin's coefficient of values, or of logs of positive ones."""
    good = df.filter((F.col(x) > 0) & (F.col(y) > 0)) if log else df
    a, b = (F.log(x), F.log(y)) if log else (F.col(x), F.col(y))
    return good.groupBy(*by).agg((2 * F.covar_samp(a, b) / (F.var_samp(a) + F.var_samp(b) + (F.avg(a) - F.avg(b)) ** 2)).alias("concordance"))


def mediation_effect(one: DataFrame, pair: DataFrame, control: str, treated: str) -> DataFrame:
    """M10. gene_1 (mediator), gene_2 (target): tau, the change of the target's mean; tau_direct, that of
    its intercept given the mediator; effect = tau - tau_direct; and the share of |tau| mediated."""
    beta = F.try_divide(F.col("cov"), F.col("var_1"))
    mean = lambda i: one.select("grp", F.col("gene_id").alias(f"gene_{i}"), F.col("mean").alias(f"mean_{i}"))
    rows = pair.filter(F.col("grp").isin(control, treated)).join(mean(1), ["grp", "gene_1"]).join(mean(2), ["grp", "gene_2"])
    alpha = F.col("mean_2") - beta * F.col("mean_1")
    of = lambda value, g: F.max(F.when(F.col("grp") == g, value))
    both = rows.groupBy("gene_1", "gene_2").agg((of(F.col("mean_2"), treated) - of(F.col("mean_2"), control)).alias("tau"), (of(alpha, treated) - of(alpha, control)).alias("tau_direct"))
    share = F.try_divide(F.abs("tau") - F.abs("tau_direct"), F.abs("tau"))
    return both.withColumn("effect", F.col("tau") - F.col("tau_direct")).withColumn("share", share)
