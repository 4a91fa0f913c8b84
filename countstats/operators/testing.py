"""Tests of differences in mean, variability and correlation, and classical tests on the same tables.

The heavy part, counting equal (value, size factor) pairs, is an aggregation; a grouped function then
sees the compressed rows of each gene or pair in each group, whose number does not depend on that of cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import special
from ..functions.columns import running_before
from ..functions.lineage import materialize
from . import bootstrap
from .draws import Design, Plan, by_segment, cells_of, drawn, summarised, tests_by_stream
from .estimators import EstimatorSpec, get_estimator
from .pvalues import bh_fdr

#: Genes of a block, and snps that it meets at once, about.
GENE_BLOCK, SNP_PART = 128, 2048
_GROUP = ["mean", "res_var", "n_cells", "q", "center", "c0", "c1", "c2"]


def _design(design: pd.DataFrame, treatments: list[str], covariates: list[str]) -> pd.DataFrame:
    """The design, one row for each group, as floats indexed by grp."""
    return design.set_index("grp")[[*treatments, *covariates]].astype(float)


def group_parameters(mom: DataFrame, groups: DataFrame, fit: DataFrame) -> DataFrame:
    """grp, gene_id and all that a gene's bootstrap needs to know of each group."""
    joined = mom.select("grp", "gene_id", "mean", "res_var").join(groups.select("grp", "n_cells", "q"), "grp")
    return joined.join(fit, "grp").select("grp", "gene_id", *_GROUP)


def _bootable(kind: str | EstimatorSpec, pairs: bool = False) -> EstimatorSpec:
    spec = get_estimator(kind)
    if spec.boot is None or (pairs and spec.cov_boot is None):
        raise ValueError("this estimator has point values only" if spec.boot is None else "this estimator has no covariance")
    return spec


def _with_covariates(params: DataFrame, keys: list[str], covariates_for: DataFrame | None) -> DataFrame:
    """``params`` with ``covs``, the names of the covariates of a gene or pair; null: all of them."""
    if covariates_for is None:
        return params.withColumn("covs", F.lit(None).cast("array<string>"))
    return params.join(covariates_for.select(*keys, F.col("covariates").alias("covs")), keys, "left")


def _design_of(frame: pd.DataFrame, treatments: list[str], covariates: list[str]) -> Design:
    frame = frame.sort_index()
    return Design(list(frame.index), list(treatments), list(covariates), frame[list(treatments)].to_numpy(), frame[list(covariates)].to_numpy())


def _heads(params: DataFrame, keys: list[str], tests: DataFrame | None, covariates_for: DataFrame | None) -> DataFrame:
    """A row for each gene or pair to be tested: ``txs``, its own tests, and ``covs``; null: those of the design."""
    known = params.select(*keys).distinct()
    if tests is None:
        known = known.withColumn("txs", F.lit(None).cast("array<struct<tx:string,dose:array<double>>>"))
    else:
        own = tests.groupBy(*keys).agg(F.collect_list(F.struct(F.col("tx").cast("string").alias("tx"), F.col("dose").cast("array<double>").alias("dose"))).alias("txs"))
        known = known.join(own, keys)
    return _with_covariates(known, keys, covariates_for).withColumn("grp", F.lit(None).cast("string"))


def _sums(plan: Plan, params: DataFrame, cells: DataFrame, tests: DataFrame | None, covariates_for: DataFrame | None, block: int | None) -> DataFrame:
    heads, segments = _heads(params, plan.keys, tests, covariates_for), params.join(cells, [*plan.keys, "grp"])
    if tests is not None:  # not all of the genes have tests
        segments = segments.join(heads.select(*plan.keys), plan.keys, "left_semi")
    return tests_by_stream(plan, segments, heads, block)


def _picks(resample_groups: bool, given: bool, seed: int):
    if not resample_groups:
        return None
    return (lambda *names: bootstrap.given_picks) if given else lambda *names: bootstrap.random_picks(seed, *names, "groups")


def _draw_means(spec: EstimatorSpec, draws: int, seed: int):
    """H4. Means and residual variances (two rows of draws) of one gene in one group, or None if it can't be tested."""

    def draw(g: dict) -> np.ndarray | None:
        if not len(g["n"]) or not (g["mean"] and np.isfinite(g["mean"])) or g["res_var"] is None or not g["res_var"] >= 0:
            return None
        rng = None if "w" in g else bootstrap.generator(seed, g["gene_id"], g["grp"])
        mean, var = drawn(g, ("x",), draws, lambda x, w, inverse, n: spec.boot(x, w, inverse, n, g["q"]), rng, spec.zeros_alike, spec.absolute)
        var = bootstrap.residual(mean, var, (g["center"], g["c0"], g["c1"], g["c2"]))
        mean = bootstrap.fill_invalid(mean, ~(mean > 0), rng)
        var = bootstrap.fill_invalid(var, ~(var > 0), rng)
        return None if mean is None or var is None else np.array([mean, var])

    return draw


def ht_1d(params: DataFrame, compressed: DataFrame, design: pd.DataFrame, treatments: list[str] = (), covariates: list[str] = (), tests: DataFrame | None = None, num_boot: int = 1000, seed: int = 5, kind: str | EstimatorSpec = "hyper_relative", approx: str = "norm", resample_groups: bool = False, covariates_for: DataFrame | None = None, block: int | None = None) -> DataFrame:
    """H8. gene, tx, de_coef, de_se, de_pval, dv_coef, dv_se, dv_pval.

    ``params`` is of ``group_parameters``, ``compressed`` of ``groups.compress`` for the same genes,
    ``design`` a small frame with one row for each grp. ``tests`` (gene_id, tx, dose: a value for each grp of
    the design in order of names, null if not known) gives each gene treatments of its own instead,
    which then never pass through the driver, and ``covariates_for`` (gene_id, covariates) some of
    ``covariates``; a gene not listed has all. Draws with an invalid group are left out of the
    regression. A gene without a valid group, or a coefficient that can't be told, has nulls.
    ``num_boot`` of 0 gives the observed coefficients. ``compressed`` may have ``w``, the ``num_boot`` weights
    of each row: then nothing is random (see ``groups.with_weights``). ``block`` is of ``draws.tests_by_stream``.
    """
    spec, frame = _bootable(kind), _design(design, list(treatments), list(covariates))
    draw = _draw_means(spec, num_boot, seed)

    def logs(g: dict) -> tuple[np.ndarray, np.ndarray] | None:
        found = draw(g)
        with np.errstate(divide="ignore"):
            return None if found is None else (np.log([g["mean"], g["res_var"]]), np.log(found))

    plan = Plan(["gene_id"], 2, num_boot, logs, _design_of(frame, treatments, covariates), _picks(resample_groups, "w" in compressed.columns, seed))
    sums = _sums(plan, params, cells_of(compressed, ["gene_id"], ["x"]), tests, covariates_for, block)
    return summarised(sums, ["gene_id"], ["de", "dv"], approx).withColumnRenamed("gene_id", "gene")


def mean_summary(params: DataFrame, compressed: DataFrame, num_boot: int = 1000, seed: int = 5, kind: str | EstimatorSpec = "hyper_relative") -> DataFrame:
    """H10. grp, gene_id, mean (of observed and drawn), sem, se_log, se_log1p; negative draws don't
    count for the logs. ``compressed`` may have given weights, as in ``ht_1d``."""
    draw = _draw_means(_bootable(kind), num_boot, seed)

    def one(g: dict) -> tuple | None:
        found = draw(g)
        if found is None:
            return None
        m = np.append(g["mean"], found[0])
        positive = m[m > 0]
        return g["grp"], g["gene_id"], float(np.nanmean(m)), float(np.nanstd(m)), float(np.std(np.log(positive))), float(np.std(np.log1p(positive)))

    segments = params.join(cells_of(compressed, ["gene_id"], ["x"]), ["gene_id", "grp"]).withColumn("gene_id", F.col("gene_id").cast("string"))
    return by_segment(segments, one, "grp string, gene_id string, mean double, sem double, se_log double, se_log1p double", ["gene_id", "grp"])


def draws_of(params: DataFrame, compressed: DataFrame, num_boot: int = 1000, seed: int = 5, kind: str | EstimatorSpec = "hyper_relative") -> DataFrame:
    """H1, H3, H4. grp, gene_id, drawn_mean, drawn_rv: the means over all draws, invalid ones replaced, of mean
    and residual variance, for each gene and group that can be tested."""
    draw = _draw_means(_bootable(kind), num_boot, seed)

    def one(g: dict) -> tuple | None:
        found = draw(g)
        return None if found is None else (g["grp"], g["gene_id"], float(found[0].mean()), float(found[1].mean()))

    segments = params.join(cells_of(compressed, ["gene_id"], ["x"]), ["gene_id", "grp"]).withColumn("gene_id", F.col("gene_id").cast("string"))
    return by_segment(segments, one, "grp string, gene_id string, drawn_mean double, drawn_rv double", ["gene_id", "grp"])


def ht_2d(pair_params: DataFrame, compressed: DataFrame, design: pd.DataFrame, treatments: list[str] = (), covariates: list[str] = (), num_boot: int = 1000, seed: int = 5, approx: str = "norm", resample_groups: bool = False, kind: str | EstimatorSpec = "hyper_relative", tests: DataFrame | None = None, covariates_for: DataFrame | None = None, block: int | None = None) -> DataFrame:
    """H9. gene_1, gene_2, tx, corr_coef (of the observed correlations), corr_se, corr_pval.

    ``pair_params``: grp, gene_1, gene_2, corr, n_cells, q. ``kind`` is the estimator of ``corr``; the
    draws use the same. ``tests`` (gene_1, gene_2, tx, dose), ``covariates_for`` (gene_1, gene_2,
    covariates), given weights and ``block`` are as in ``ht_1d``. One draw of weights serves covariance
    and both variances. A group whose correlation is missing or +-1 is skipped; pairs of one gene have nulls.
    """
    spec, frame, keys = _bootable(kind, pairs=True), _design(design, list(treatments), list(covariates)), ["gene_1", "gene_2"]

    def draw(g: dict) -> tuple[np.ndarray, np.ndarray] | None:
        if not len(g["n"]) or g["gene_1"] == g["gene_2"] or g["corr"] is None or not abs(g["corr"]) < 1:
            return None

        def statistic(x1, x2, w, inverse, n):
            v1, v2 = (spec.boot(x, w, inverse, n, g["q"])[1] for x in (x1, x2))
            cov = spec.cov_boot(x1, x2, w, inverse, n, g["q"])
            with np.errstate(invalid="ignore", divide="ignore"):
                return (np.where((v1 > 0) & (v2 > 0), cov / np.sqrt(v1 * v2), np.nan),)

        rng = None if "w" in g else bootstrap.generator(seed, g["gene_1"], g["gene_2"], g["grp"])
        (r,) = drawn(g, ("x1", "x2"), num_boot, statistic, rng, spec.zeros_alike, spec.absolute)
        r = bootstrap.fill_invalid(r, ~(np.abs(r) < 1), rng)
        return None if r is None else (np.array([g["corr"]]), r[None, :])

    plan = Plan(keys, 1, num_boot, draw, _design_of(frame, treatments, covariates), _picks(resample_groups, "w" in compressed.columns, seed))
    params = pair_params.select("grp", *keys, "corr", "n_cells", "q")
    sums = _sums(plan, params, cells_of(compressed, keys, ["x1", "x2"]), tests, covariates_for, block)
    return summarised(sums, keys, ["corr"], approx, observed_only=True)


def ht_mean(summary: DataFrame, totals: DataFrame, design: pd.DataFrame, treatments: list[str], covariates: list[str] = (), tests: DataFrame | None = None, shrink: float = 0.25, covariates_for: DataFrame | None = None) -> DataFrame:
    """H12. gene_id, tx, coef, se, pval of quasi-likelihood tests of the mean.

    ``tests`` (gene_id, tx) names the treatments of each gene, ``covariates_for`` (gene_id, covariates) its
    covariates. ``summary`` is of ``mean_summary``, ``totals`` has grp and total. Each (gene, tx) has a Poisson fit
    with offset ln(total) (H11); the mean slope of log residual variance on log fit over all tests is
    one number, clipped to [0, 2] and shrunk to 2; it sets the variance between groups.
    """
    frame = _design(design, treatments, list(covariates))
    rows = summary.join(totals.select("grp", "total"), "grp").groupBy("gene_id").agg(F.sort_array(F.collect_list(F.struct("grp", "mean", "sem", "total"))).alias("g"))
    spark = summary.sparkSession
    txs = spark.createDataFrame([(t,) for t in treatments], "tx string")
    rows = rows.join(tests, "gene_id") if tests is not None else rows.crossJoin(txs)
    rows = _with_covariates(rows, ["gene_id"], covariates_for)

    def fit(batches):
        for batch in batches:
            out = []
            for gene, g, tx, covs in zip(batch["gene_id"], batch["g"], batch["tx"], batch["covs"]):
                own = [r for r in g if r["grp"] in frame.index]
                names = [r["grp"] for r in own]
                if tx not in frame.columns or not own:
                    continue
                total = np.array([r["total"] for r in own], dtype=float)
                y = np.array([r["mean"] for r in own]) * total
                spread = (np.array([r["sem"] for r in own]) * total) ** 2
                x = np.column_stack([np.ones(len(own)), frame.loc[names, list(covariates if covs is None else covs)].to_numpy(), frame.loc[names, tx].to_numpy()])
                found = bootstrap.loglinear(y, x, np.log(total))
                if found is None:
                    continue
                beta, pred = found
                gap = (pred - y) ** 2
                use = (gap > 0) & (pred > 0)
                slope = np.polyfit(np.log10(pred[use]), np.log10(gap[use]), 1)[0] if use.sum() > 1 and np.ptp(np.log10(pred[use])) > 0 else math.nan
                out.append((gene, tx, float(beta[-1]), None if math.isnan(slope) else float(slope), pred.tolist(), spread.tolist(), x.ravel().tolist()))
            yield pd.DataFrame(out, columns=["gene_id", "tx", "coef", "slope", "pred", "spread", "x"])

    fits = materialize(rows.mapInPandas(fit, "gene_id string, tx string, coef double, slope double, pred array<double>, spread array<double>, x array<double>"))
    slope = fits.agg(F.coalesce(shrink * F.least(F.greatest(F.avg("slope"), F.lit(0.0)), F.lit(2.0)) + (1 - shrink) * 2, F.lit(2.0)).alias("mv"))

    def errors(batches):
        for batch in batches:
            out = []
            for gene, tx, coef, pred, spread, x, mv in zip(*(batch[c] for c in ("gene_id", "tx", "coef", "pred", "spread", "x", "mv"))):
                pred, spread = np.array(pred), np.array(spread)
                x = np.array(x).reshape(len(pred), -1)
                w = pred**2 / (spread + pred**mv)
                se = math.sqrt(max(0.0, np.diag(np.linalg.pinv((x * w[:, None]).T @ x))[-1]))
                out.append((gene, tx, coef, se, float(special.two_sided_normal(coef / se)[0]) if se > 0 else None))
            yield pd.DataFrame(out, columns=["gene_id", "tx", "coef", "se", "pval"])

    return fits.crossJoin(F.broadcast(slope)).mapInPandas(errors, "gene_id string, tx string, coef double, se double, pval double")


def pairwise_cube_effects(cube: DataFrame, label: str, a: str, b: str) -> DataFrame:
    """H16. gene_id, lfc, se, z of two rows of a cube from mean and sem alone; se of a log is half the
    log's change over +-sem, and null where that reaches 0."""
    side = lambda v, i: cube.filter(F.col(label) == v).select("gene_id", F.col("mean").alias(f"m{i}"), F.when(F.col("mean") > F.col("sem"), (F.log(F.col("mean") + F.col("sem")) - F.log(F.col("mean") - F.col("sem"))) / 2).alias(f"s{i}"))
    lfc, se = F.log("m2") - F.log("m1"), F.sqrt(F.col("s1") ** 2 + F.col("s2") ** 2)
    return side(a, 1).join(side(b, 2), "gene_id").filter("m1 > 0 and m2 > 0").select("gene_id", lfc.alias("lfc"), se.alias("se"), F.try_divide(lfc, se).alias("z"))


def pairwise_cube_test(cube: DataFrame, label: str, a: str, b: str) -> DataFrame:
    return pairwise_cube_effects(cube, label, a, b).withColumn("pval", special.normal_p(F.col("z")))


def meta_wls(cube: DataFrame, treatment: str, block: str, min_cells: int = 20, min_share: float = 0.7) -> DataFrame:
    """H17. gene_id, coef, se, pval of a treatment level (0/1 column) over blocks.

    Only blocks with both levels count; genes in fewer than ``min_share`` of the (block, level) groups
    are left out; a gene's rows need more than ``min_cells`` cells and a block with both levels. The
    design has the treatment, centred block dummies, their products with it, and a constant; the
    coefficient is that of plain least squares, the variance from inverse squared errors. Blocks have
    intercepts and slopes of their own in that design, so each is eliminated by its own sums: the
    coefficient is the mean of the blocks' slopes over rows, whatever the number of blocks.
    """
    both = cube.groupBy(block).agg(F.count_distinct(treatment).alias("_levels")).filter("_levels > 1").select(block)
    rows = cube.join(both, block, "left_semi").filter((F.col("n_obs") > min_cells) & (F.col("mean") > 0) & (F.col("sem") > 0))
    total = cube.join(both, block, "left_semi").select(block, treatment).distinct().agg(F.count("*").alias("_all"))
    known = rows.groupBy("gene_id").agg(F.count("*").alias("_n")).crossJoin(F.broadcast(total)).filter(F.col("_n") >= min_share * F.col("_all")).select("gene_id")
    complete = Window.partitionBy("gene_id", block)
    rows = rows.join(known, "gene_id", "left_semi").withColumn("_levels", F.min(treatment).over(complete) != F.max(treatment).over(complete)).filter("_levels")
    rows = rows.select("gene_id", F.col(treatment).cast("double").alias("t"), F.col(block).alias("b"), F.log("mean").alias("y"), F.pow(F.col("mean") / F.col("sem"), 2).alias("w"))
    t, y, w = F.col("t"), F.col("y"), F.col("w")
    sums = rows.groupBy("gene_id", "b").agg(F.count("*").alias("n"), F.sum(t).alias("st"), F.sum(y).alias("sy"), F.sum(t * t).alias("tt"), F.sum(t * y).alias("ty"), F.sum(w).alias("sw"), F.sum(w * t).alias("wt"), F.sum(w * t * t).alias("wtt"))
    n = F.col("n")
    slope = (F.col("ty") - F.col("st") * F.col("sy") / n) / (F.col("tt") - F.col("st") * F.col("st") / n)
    variance = 1 / (F.col("wtt") - F.col("wt") * F.col("wt") / F.col("sw"))
    found = sums.groupBy("gene_id").agg((F.sum(n * slope) / F.sum(n)).alias("coef"), (F.sqrt(F.sum(n * n * variance)) / F.sum(n)).alias("se"))
    return found.withColumn("pval", special.normal_p(F.try_divide(F.col("coef"), F.col("se"))))


def student_t(counts: DataFrame, cells: DataFrame, treatment: str) -> DataFrame:
    """H18. gene_id, diff (of means, level 1 less level 0), t, df with pooled variances, zeros among
    the values; ``treatment`` is a 0/1 column of cells."""
    sizes = cells.agg(F.count_if(F.col(treatment) == 0).alias("n0"), F.count_if(F.col(treatment) == 1).alias("n1"))
    rows = counts.join(cells.select("cell_id", F.col(treatment).alias("_t")), "cell_id")
    part = lambda level, c: F.coalesce(F.sum(F.when(F.col("_t") == level, c)), F.lit(0.0))
    x = F.col("x").cast("double")
    sums = rows.groupBy("gene_id").agg(*[part(i, v).alias(f"{n}{i}") for i in (0, 1) for n, v in (("s", x), ("ss", x * x))]).crossJoin(F.broadcast(sizes))
    mean = [F.col(f"s{i}") / F.col(f"n{i}") for i in (0, 1)]
    within = sum((F.col(f"ss{i}") - mean[i] * mean[i] * F.col(f"n{i}") for i in (0, 1)), F.lit(0.0))
    df = F.col("n0") + F.col("n1") - 2
    t = F.try_divide(mean[1] - mean[0], F.sqrt(within / df * (1 / F.col("n0") + 1 / F.col("n1"))))
    return sums.select("gene_id", (mean[1] - mean[0]).alias("diff"), t.alias("t"), df.alias("df"))


def student_t_test(counts: DataFrame, cells: DataFrame, treatment: str) -> DataFrame:
    return student_t(counts, cells, treatment).withColumn("pval", special.student_p(F.col("t"), F.col("df")))


def mann_whitney(counts: DataFrame, cells: DataFrame, treatment: str) -> DataFrame:
    """H19. gene_id, u, z of level 1 against level 0 of a 0/1 column, with average ranks, zeros among the
    values, corrected for ties; ``cc`` is half a rank off the distance for continuity. Only the
    distinct values of a gene are ordered, never the cells."""
    sizes = cells.agg(F.count_if(F.col(treatment) == 0).alias("n0"), F.count_if(F.col(treatment) == 1).alias("n1"))
    rows = counts.filter("x <> 0").join(cells.select("cell_id", F.col(treatment).alias("_t")).filter("_t in (0, 1)"), "cell_id")
    seen = rows.groupBy("gene_id", "x").agg(F.count_if(F.col("_t") == 0).alias("a0"), F.count_if(F.col("_t") == 1).alias("a1"))
    rest = seen.groupBy("gene_id").agg(F.sum("a0").alias("b0"), F.sum("a1").alias("b1")).crossJoin(F.broadcast(sizes))
    zeros = rest.select("gene_id", F.lit(0).cast(counts.schema["x"].dataType).alias("x"), (F.col("n0") - F.col("b0")).alias("a0"), (F.col("n1") - F.col("b1")).alias("a1"))
    every = seen.unionByName(zeros).withColumn("c", F.col("a0") + F.col("a1")).filter("c > 0")
    before = F.coalesce(F.sum("c").over(Window.partitionBy("gene_id").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = F.col("c").cast("double")
    ranked = every.withColumn("rank", before + (F.col("c") + 1) / 2)
    sums = ranked.groupBy("gene_id").agg(F.sum(F.col("a1") * F.col("rank")).alias("w"), F.sum(c * c * c - c).alias("ties")).crossJoin(F.broadcast(sizes))
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    n, u = n0 + n1, F.col("w") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n0 * n1 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    gap = u - n0 * n1 / 2
    return sums.select("gene_id", u.alias("u"), F.try_divide(gap, sd).alias("z"), F.try_divide(F.lit(0.5), sd).alias("cc"))


def mann_whitney_test(counts: DataFrame, cells: DataFrame, treatment: str, alternative: str = "two-sided") -> DataFrame:
    found = mann_whitney(counts, cells, treatment)
    if alternative == "two-sided":
        return found.withColumn("pval", special.normal_p(F.greatest(F.abs("z") - F.col("cc"), F.lit(0.0))))
    if alternative != "greater":
        raise ValueError("alternative must be 'two-sided' or 'greater'")
    return found.withColumn("pval", special.vectorised(special.normal_sf)(F.col("z") - F.col("cc")))


def ks_2samp(df: DataFrame, value: str, sample: str, by: list[str]) -> DataFrame:
    """H20. ``by``, d, n0, n1, and the asymptotic p; ``sample`` is a 0/1 column. Distinct values are
    counted first, so equal ones cost nothing, and put in order by ranges."""
    counts = df.groupBy(*by, value).agg(F.count_if(F.col(sample) == 0).alias("a0"), F.count_if(F.col(sample) == 1).alias("a1"))
    placed = materialize(running_before(counts, by, [value], {"_b0": F.col("a0"), "_b1": F.col("a1")}))
    upto = [(F.col(f"_b{i}") + F.col(f"a{i}")).alias(f"_c{i}") for i in (0, 1)]
    totals = placed.groupBy(*by).agg(F.sum("a0").alias("n0"), F.sum("a1").alias("n1"))
    rows = placed.select(*by, *upto).join(totals, by) if by else placed.select(*upto).crossJoin(F.broadcast(totals))  # one row
    found = rows.groupBy(*by, "n0", "n1").agg(F.max(F.abs(F.col("_c0") / F.col("n0") - F.col("_c1") / F.col("n1"))).alias("d"))
    scaled = F.col("d") ** 2 * F.col("n0") * F.col("n1") / (F.col("n0") + F.col("n1"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2 * scaled * k * k))
    return found.withColumn("pval", F.when(scaled < 0.02, 1.0).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0))))


def crosstab(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """H21. ``by``, n11, n10, n01, n00, chi2 (with Yates' correction) of two flags."""
    flag = lambda x, y: F.count_if((F.col(a) == x) & (F.col(b) == y))
    n = df.groupBy(*by).agg(flag(True, True).alias("n11"), flag(True, False).alias("n10"), flag(False, True).alias("n01"), flag(False, False).alias("n00"))
    w, x, y, z = (F.col(c).cast("double") for c in ("n11", "n10", "n01", "n00"))
    total = w + x + y + z
    gap = F.abs(w * z - x * y) - F.least(total / 2, F.abs(w * z - x * y))
    return n.withColumn("chi2", F.try_divide(total * gap * gap, (w + x) * (y + z) * (w + y) * (x + z)))


def crosstab_test(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    found = crosstab(df, a, b, by)
    return found.withColumn("chi2_pval", special.chi2_p(F.col("chi2"), F.lit(1))).withColumn("fisher_pval", special.fisher_p(*(F.col(c) for c in ("n11", "n10", "n01", "n00"))))


def chi2_table(df: DataFrame, a: str, b: str) -> DataFrame:
    """H21. chi2, df, pval of an r x c table."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    rows, columns = cells.groupBy(a).agg(F.sum("n").alias("_r")), cells.groupBy(b).agg(F.sum("n").alias("_c"))
    total = cells.agg(F.sum("n").alias("_t"))
    # Empty cells add their expected number; all of these add up to the total.
    seen = cells.join(rows, a).join(columns, b).crossJoin(F.broadcast(total))
    expected = F.col("_r") * F.col("_c") / F.col("_t")
    sums = seen.agg(F.sum((F.col("n") - expected) ** 2 / expected - expected).alias("s"), F.max("_t").alias("_t"), F.count_distinct(a).alias("r"), F.count_distinct(b).alias("c"))
    found = sums.select((F.col("s") + F.col("_t")).alias("chi2"), ((F.col("r") - 1) * (F.col("c") - 1)).alias("df"))
    return found.withColumn("pval", special.chi2_p(F.col("chi2"), F.col("df")))


def binomial_test(df: DataFrame, success: str, by: list[str]) -> DataFrame:
    """H22. ``by``, k, n, pval: two-sided exact for p = 0.5."""
    found = df.groupBy(*by).agg(F.count_if(F.col(success)).alias("k"), F.count(success).alias("n")).filter("n > 0")
    return found.withColumn("pval", special.binomial_p(F.col("k"), F.col("n")))


def _vectors(values: DataFrame, index: DataFrame, key: str, covariates: np.ndarray | None) -> DataFrame:
    """``key`` and ``v``: a value for each individual of ``index`` (individual, place), less their fit on the
    covariates and an intercept; nan where there is none."""
    n = index.count()
    listed = values.join(index, "individual").groupBy(key).agg(F.collect_list(F.struct("place", F.col("value").cast("double").alias("value"))).alias("d"))

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, counts = batch.column("d").flatten(), pc.list_value_length(batch.column("d")).to_numpy()
            v = np.full((len(batch), n), np.nan)
            v[np.repeat(np.arange(len(batch)), counts), flat.field("place").to_numpy()] = flat.field("value").to_numpy(zero_copy_only=False)
            for missing in np.unique(np.isnan(v), axis=0):  # rows of the same individuals at once
                rows, known = (np.isnan(v) == missing).all(axis=1), ~missing
                c = np.zeros((int(known.sum()), 0)) if covariates is None else covariates[known]
                v[np.ix_(rows, known)] = bootstrap._without(v[np.ix_(rows, known)].T, c, np.ones(len(c))).T
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), n).cast(pa.list_(pa.float64()))], names=[key, "v"])

    return listed.mapInArrow(dense, T.StructType([listed.schema[key], T.StructField("v", T.ArrayType(T.DoubleType()))]))


def same_individuals(*tables: DataFrame) -> None:
    """An error unless all tables have the same set of ``individual``."""
    first, *rest = (t.select("individual").distinct() for t in tables)
    for other in rest:
        if first.join(other, "individual", "left_anti").limit(1).count() or other.join(first, "individual", "left_anti").limit(1).count():
            raise ValueError("the tables must be of the same individuals")


def pseudobulk_linear(expression: DataFrame, genotypes: DataFrame, pairs: DataFrame, covariates: DataFrame | None = None) -> DataFrame:
    """H23. gene_id, snp, beta, t, df of a linear regression of expression (gene_id, individual, value)
    on dosage (snp, individual, dosage) and covariates (individual, name, value), for listed (gene_id, snp).

    Either side is freed of the covariates once and becomes a vector over an index of individuals. Genes
    meet their snps in tiles: a block of genes with a part of the snps that any of them is paired with,
    and sums of all pairs of a tile are products of two matrices. That is the whole regression only if
    all tables are of the same individuals, which is checked. Covariates, a row for each individual, are on the driver.
    """
    same_individuals(expression, genotypes, *([covariates] if covariates is not None else []))
    individuals = expression.select("individual").distinct()
    index = materialize(individuals.withColumn("place", F.row_number().over(Window.orderBy("individual")) - 1))  # one row for each individual
    known, n_covariates = None, 0
    if covariates is not None:
        wide = covariates.join(index, "individual").toPandas().pivot(index="place", columns="name", values="value").sort_index()
        known, n_covariates = wide.to_numpy(dtype=float), wide.shape[1]
    y = materialize(_vectors(expression, index, "gene_id", known))
    g = materialize(_vectors(genotypes.withColumnRenamed("dosage", "value"), index, "snp", known))
    listed = pairs.select("gene_id", "snp").distinct().join(y.select("gene_id"), "gene_id", "left_semi").join(g.select("snp"), "snp", "left_semi")
    blocks = max(1, y.count() // GENE_BLOCK)
    listed = materialize(listed.withColumn("block", F.pmod(F.xxhash64("gene_id"), F.lit(blocks))))
    parts = materialize(listed.groupBy("block").agg(F.ceil(F.approx_count_distinct("snp") / SNP_PART).alias("parts")))
    listed = listed.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("snp"), F.col("parts")))
    genes = listed.groupBy("block", "part", "gene_id").agg(F.collect_list("snp").alias("snps")).join(y, "gene_id")
    snps = listed.select("block", "part", "snp").distinct().join(g, "snp")

    def multiply(left: pa.Table, right: pa.Table) -> pa.Table:
        of = lambda t: t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
        if not len(left) or not len(right):
            return left.select(["gene_id"]).slice(0, 0).append_column("snp", right.column("snp").slice(0, 0)).append_column("sums", pa.array([], pa.list_(pa.float64())))
        a, b = of(left), of(right)
        here, there = ~np.isnan(a), ~np.isnan(b)
        a, b, here, there = np.nan_to_num(a), np.nan_to_num(b), here.astype(float), there.astype(float)
        place = {s: i for i, s in enumerate(right.column("snp").to_pylist())}
        rows = np.repeat(np.arange(len(left)), pc.list_value_length(left.column("snps")).to_numpy())
        columns = np.array([place[s] for s in left.column("snps").combine_chunks().flatten().to_pylist()])
        sums = [(x @ z.T)[rows, columns] for x, z in ((a, b), (here, b * b), (a * a, there), (here, there))]
        listed_ = pa.FixedSizeListArray.from_arrays(pa.array(np.column_stack(sums).ravel()), 4).cast(pa.list_(pa.float64()))
        return pa.table({"gene_id": left.column("gene_id").take(pa.array(rows)), "snp": right.column("snp").take(pa.array(columns)), "sums": listed_})

    tasks = max(y.sparkSession.sparkContext.defaultParallelism, int(y.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tiles = lambda side, *columns: side.select(*[F.col(c).alias(c) for c in ("block", "part")], *columns).repartition(tasks, "block", "part").groupBy("block", "part")
    out = T.StructType([y.schema["gene_id"], g.schema["snp"], T.StructField("sums", T.ArrayType(T.DoubleType()))])
    products = tiles(genes, "gene_id", "v", "snps").cogroup(tiles(snps, "snp", "v")).applyInArrow(multiply, out)
    sums = products.select("gene_id", "snp", *[F.col("sums")[i].alias(c) for i, c in enumerate(("gy", "gg", "yy"))], F.col("sums")[3].cast("long").alias("n"))
    beta, df = F.try_divide(F.col("gy"), F.col("gg")), F.col("n") - 2 - n_covariates
    rest = F.greatest(F.col("yy") - beta * F.col("gy"), F.lit(0.0))
    t = F.when(df > 0, F.try_divide(beta, F.sqrt(rest / df / F.col("gg"))))
    return sums.filter("gg > 1e-9").select("gene_id", "snp", beta.alias("beta"), t.alias("t"), df.alias("df"))


def cis_association(expression: DataFrame, genotypes: DataFrame, pairs: DataFrame, covariates: DataFrame | None = None) -> DataFrame:
    """H23. With p and fdr."""
    found = pseudobulk_linear(expression, genotypes, pairs, covariates)
    return bh_fdr(found.withColumn("pval", special.student_p(F.col("t"), F.col("df"))))


def log1p_wls(means: DataFrame, design: pd.DataFrame, treatments: list[str], covariates: list[str] = ()) -> DataFrame:
    """H24. gene_id, tx, coef, se, pval: weighted least squares of ln(1 + mean) over groups, weights from
    half the log's change over +-sem; an error of 0 becomes the smallest positive one."""
    frame = _design(design, treatments, list(covariates))

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["grp"].isin(frame.index)].sort_values("grp")
        m, s = rows["mean"].to_numpy(dtype=float), rows["sem"].to_numpy(dtype=float)
        se = (np.log1p(m + s) - np.log1p(np.maximum(m - s, -0.999999))) / 2
        positive = se[se > 0]
        out = []
        if len(positive):
            w = 1 / np.where(se > 0, se, positive.min()) ** 2
            for t in treatments:
                x = np.column_stack([np.ones(len(rows)), frame.loc[rows["grp"], [*covariates, t]].to_numpy()])
                out.append((key[0], t, *bootstrap.weighted_line(np.log1p(m), x, w)))
        return pd.DataFrame(out, columns=["gene_id", "tx", "coef", "se", "pval"])

    return means.select("gene_id", "grp", "mean", "sem").groupBy("gene_id").applyInPandas(run, "gene_id string, tx string, coef double, se double, pval double")
