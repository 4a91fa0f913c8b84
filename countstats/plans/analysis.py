"""Whole analyses: from counts and cells to moments, and to tests of differences."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import materialize
from ..operators import estimators, groups, meanvar, testing
from ..operators.pvalues import bh_fdr


@dataclass(frozen=True)
class Analysis:
    """What the steps share, as DataFrames. ``cells`` has grp, size_factor and sf_bin; ``moments`` holds
    kept genes with their residual variance; ``fit`` the mean-variance curve of each group."""

    counts: DataFrame
    cells: DataFrame
    groups: DataFrame
    moments: DataFrame
    fit: DataFrame
    kind: str | estimators.EstimatorSpec

    @property
    def parameters(self) -> DataFrame:
        return testing.group_parameters(self.moments, self.groups, self.fit)

    @property
    def compressed(self) -> DataFrame:
        return groups.compress(self.counts, self.cells, self.moments)


def size_factors(counts: DataFrame, cells: DataFrame, kind: str | estimators.EstimatorSpec = "hyper_relative", mean_threshold: float = 0.07, trim_percent: float = 0.1, shrinkage: float = 0.5) -> DataFrame:
    """S1-S4. ``cells`` without empty ones, with size_factor from the least variable genes. What later
    steps read more than once, a row for each cell or gene, is written once."""
    if estimators.get_estimator(kind).absolute:
        return groups.total_size_factor(counts, cells, absolute=True)
    total = materialize(groups.total_size_factor(counts, cells).filter("size_factor > 0"))
    overall = materialize(estimators.moments(counts, total, [], "hyper_relative"))
    genes = meanvar.least_variable_genes(overall, trim_percent, mean_threshold)
    return materialize(groups.trimmed_size_factor(counts, total.drop("size_factor"), genes, shrinkage))


def analyse(counts: DataFrame, cells: DataFrame, labels: list[str], kind: str | estimators.EstimatorSpec = "hyper_relative", min_share: float = 0.7, mean_threshold: float = 0.07, trim_percent: float = 0.1, shrinkage: float = 0.5, num_bins: int = 30, min_cell_count: int = 10, genes: DataFrame | None = None) -> Analysis:
    """E11. Size factors, groups, moments, gene filters, fits and residual variances. ``genes`` limits
    the result after the fits."""
    counts = materialize(counts)
    sized = groups.bin_size_factor(size_factors(counts, cells, kind, mean_threshold, trim_percent, shrinkage), num_bins)
    grouped, table = groups.create_groups(sized, labels, min_cell_count=min_cell_count)
    grouped, table = materialize(grouped), materialize(table)
    one = materialize(estimators.moments(counts, grouped, ["grp"], kind))
    kept = meanvar.gene_filters(one, table, mean_threshold, min_share)
    one = one.join(kept.select("gene_id"), "gene_id", "left_semi")
    fit = materialize(meanvar.fit_mean_variance(one) if estimators.get_estimator(kind).fitted else meanvar.flat_fit(table))
    one = meanvar.with_residual_variance(one, fit)
    if genes is not None:
        one = one.join(genes.select("gene_id"), "gene_id", "left_semi")
    return Analysis(counts, grouped, table, materialize(one), fit, kind)


def design_of(a: Analysis, columns: list[str]) -> pd.DataFrame:
    """The group table on the driver: one row for each group, label columns as they are."""
    return a.groups.select("grp", *columns).orderBy("grp").toPandas()


def binary_test_1d(counts: DataFrame, cells: DataFrame, treatment: str, replicates: list[str] = (), num_boot: int = 1000, seed: int = 5, **options) -> DataFrame:
    """H13. Tests of a 0/1 ``treatment`` column of cells, with a dummy for each replicate but one; with
    fdr of both tests."""
    a = analyse(counts, cells, [treatment, *replicates], min_share=options.pop("min_share", 0.9), **options)
    design = design_of(a, [treatment, *replicates])
    dummies = pd.get_dummies(design[list(replicates)].astype(str), drop_first=True).astype(float) if replicates else pd.DataFrame(index=design.index)
    design = pd.concat([design[["grp", treatment]], dummies], axis=1)
    found = testing.ht_1d(a.parameters, a.compressed, design, [treatment], list(dummies.columns), num_boot=num_boot, seed=seed, kind=a.kind)
    return bh_fdr(bh_fdr(found, "de_pval", out="de_fdr"), "dv_pval", out="dv_fdr")


def pair_analysis(a: Analysis, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pair moments and compressed pairs of those whose genes were both kept."""
    kept = a.moments.select("gene_id").distinct()
    pairs = pairs.join(kept.withColumnRenamed("gene_id", "gene_1"), "gene_1", "left_semi").join(kept.withColumnRenamed("gene_id", "gene_2"), "gene_2", "left_semi").select("gene_1", "gene_2")
    mom = materialize(estimators.pair_moments(a.counts, a.cells, pairs, a.moments, ["grp"], a.kind))
    params = mom.join(a.groups.select("grp", "n_cells", "q"), "grp")
    return params, groups.compress_pairs(a.counts, a.cells, pairs)


def binary_test_2d(counts: DataFrame, cells: DataFrame, pairs: DataFrame, treatment: str, replicates: list[str] = (), num_boot: int = 1000, seed: int = 5, **options) -> DataFrame:
    """H14. The same for correlations of listed pairs."""
    a = analyse(counts, cells, [treatment, *replicates], min_share=options.pop("min_share", 0.9), **options)
    params, compressed = pair_analysis(a, pairs)
    design = design_of(a, [treatment, *replicates])
    dummies = pd.get_dummies(design[list(replicates)].astype(str), drop_first=True).astype(float) if replicates else pd.DataFrame(index=design.index)
    return testing.ht_2d(params, compressed, pd.concat([design[["grp", treatment]], dummies], axis=1), [treatment], list(dummies.columns), num_boot, seed, kind=a.kind)


def mean_test(counts: DataFrame, cells: DataFrame, treatment: str, replicates: list[str], num_boot: int = 1000, seed: int = 5, **options) -> DataFrame:
    """H12 on groups of treatment and replicate."""
    a = analyse(counts, cells, [treatment, *replicates], **options)
    totals = a.counts.join(a.cells.select("cell_id", "grp"), "cell_id").groupBy("grp").agg(F.sum("x").cast("double").alias("total"))
    summary = testing.mean_summary(a.parameters, a.compressed, num_boot, seed, a.kind)
    return testing.ht_mean(summary, totals, design_of(a, [treatment]), [treatment])


def doses_by_group(genotypes: DataFrame, a: Analysis, individual: str) -> DataFrame:
    """(tx, dose) of each snp of genotypes (individual, snp, dosage): a value for each group of ``a`` in order
    of names, null where there is none; groups are individuals, and an individual has one dosage of a snp."""
    names = sorted((r["grp"], r["i"]) for r in a.groups.select("grp", F.col(individual).cast("string").alias("i")).collect())  # a row for each group
    places = F.broadcast(genotypes.sparkSession.createDataFrame([(i, n) for n, (_, i) in enumerate(names)], "individual string, place int"))
    rows = genotypes.withColumn("individual", F.col("individual").cast("string")).join(places, "individual")
    found = rows.groupBy(F.col("snp").alias("tx")).agg(F.collect_list(F.struct("place", F.col("dosage").cast("double").alias("dosage"))).alias("d"))

    def dense(batches):
        for batch in batches:
            out = []
            for doses in batch["d"]:
                row = np.full(len(names), np.nan)
                at = np.array([d["place"] for d in doses], dtype=int)
                if len(set(at.tolist())) < len(at):
                    raise ValueError("an individual has several dosages of one snp")
                row[at] = [np.nan if d["dosage"] is None else d["dosage"] for d in doses]
                out.append(row)
            yield pd.DataFrame({"tx": batch["tx"], "dose": out})

    return found.mapInPandas(dense, "tx string, dose array<double>")


def run_eqtl(counts: DataFrame, cells: DataFrame, genotypes: DataFrame, covariates: DataFrame, pairs: DataFrame, individual: str = "individual", num_boot: int = 1000, seed: int = 5, q: float = 0.1, **options) -> DataFrame:
    """H15. Tests of dosage (individual, snp, dosage) for listed (gene_id, snp), with covariates
    (individual, name, value) and a bootstrap over individuals. The three tables must be of the same
    individuals. Doses travel with their gene; only covariates, one row for each individual, are on
    the driver."""
    testing.same_individuals(cells.select(F.col(individual).alias("individual")), genotypes, covariates)
    a = analyse(counts, cells.withColumn("q", F.lit(q)), [individual], kind="mean_only", min_share=0.3, **options)
    names = a.groups.select("grp", F.col(individual).alias("individual"))
    tests = pairs.select("gene_id", F.col("snp").alias("tx")).distinct().join(doses_by_group(genotypes, a, individual), "tx").select("gene_id", "tx", "dose")
    wide = covariates.join(names, "individual").toPandas().pivot(index="grp", columns="name", values="value").reset_index()
    return testing.ht_1d(a.parameters, a.compressed, wide, [], [c for c in wide.columns if c != "grp"], tests, num_boot, seed, "mean_only", resample_groups=True)
