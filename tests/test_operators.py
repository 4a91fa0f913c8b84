"""Hand-made fixtures, invariances and statistical properties of the count-matrix operators."""

from __future__ import annotations

import math
import threading
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from countstats.functions import columns, special
from countstats.functions.lineage import materialize
from countstats.operators import bootstrap, cube, estimators, groups, intervals, meanvar, prep, products, pvalues, tables, testing
from countstats.plans import analysis
from countstats.sources import io

COUNTS = [(1, "a", 2), (1, "b", 1), (2, "a", 3), (3, "a", 1), (3, "b", 4), (4, "c", 2)]


@pytest.fixture(scope="module")
def counts(spark):
    return spark.createDataFrame(COUNTS, "cell_id bigint, gene_id string, x bigint")


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame([(i, "g1" if i < 3 else "g2", 0.1) for i in range(1, 6)], "cell_id bigint, grp string, q double")


def by_key(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_tails_against_known_values():
    assert special.two_sided_normal(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert special.two_sided_t(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert special.chi2_sf(18.307038, 10) == pytest.approx(0.05, abs=1e-7)
    assert special.chi2_sf(3.0, 2) == pytest.approx(math.exp(-1.5), rel=1e-12)
    assert special.incomplete_beta(2, 3, 0.4) == pytest.approx(1 - special.incomplete_beta(3, 2, 0.6), rel=1e-12)
    assert special.binomial_two_sided(2, 10) == pytest.approx(0.109375)
    assert special.fisher_two_sided(8, 2, 1, 5) == pytest.approx(0.0349650, abs=1e-6)
    assert special.hypergeometric_sf(0, 10, 4, 5) == pytest.approx(1.0)


def test_tails_over_batches_by_definition(monkeypatch):
    x = np.array([0.3, 1.0, 4.5, 9.99, 10.0, 33.3, 1e6])
    assert special.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-13)
    z = np.linspace(-6, 6, 41)
    assert special.two_sided_normal(z) == pytest.approx([math.erfc(abs(v) / math.sqrt(2)) for v in z], rel=1e-11)
    assert special.normal_sf(z) == pytest.approx([0.5 * math.erfc(v / math.sqrt(2)) for v in z], rel=1e-11)
    choose = lambda n, k: math.comb(int(n), int(k))
    for terms in (4_000_000, 3):
        monkeypatch.setattr(special, "_TERMS", terms)
        k, n = np.array([0, 3, 5, 9, 40]), np.array([1, 10, 10, 9, 100])
        want = [min(1, sum(choose(m, i) for i in range(m + 1) if choose(m, i) <= choose(m, a) * (1 + 1e-7)) / 2**m) for a, m in zip(k.tolist(), n.tolist())]
        assert special.binomial_two_sided(k, n) == pytest.approx(want)
        tables_ = np.array([[3, 1, 2, 9], [0, 5, 5, 0], [7, 7, 7, 7], [1, 0, 0, 1]])
        for row, got in zip(tables_.tolist(), special.fisher_two_sided(*tables_.T)):
            a, b, c, d = row
            p = {i: choose(a + b, i) * choose(c + d, a + c - i) / choose(a + b + c + d, a + c) for i in range(max(0, a - d), min(a + b, a + c) + 1)}
            assert got == pytest.approx(sum(v for v in p.values() if v <= p[a] * (1 + 1e-7)))
        got = special.hypergeometric_sf(np.array([2, 0, 5]), np.array([20, 9, 30]), np.array([7, 4, 10]), np.array([6, 3, 12]))
        want = [sum(choose(m, i) * choose(n - m, d - i) for i in range(k, min(m, d) + 1)) / choose(n, d) for k, n, m, d in ((2, 20, 7, 6), (0, 9, 4, 3), (5, 30, 10, 12))]
        assert got == pytest.approx(want)


def test_running_sums_ranks_and_quantiles(spark):
    rng = np.random.default_rng(2)
    made = [(["a", "b", None][int(i) % 3], float(rng.integers(0, 20)), int(i)) for i in range(400)]
    frame = spark.createDataFrame(made, "g string, v double, k int").repartition(5)
    rows = columns.running_before(frame, ["g"], ["v", "k"], {"before": F.col("k"), "number": F.lit(1)}).collect()
    for r in rows:
        assert r["before"] == sum(k for g, v, k in made if g == r["g"] and (v, k) < (r["v"], r["k"]))
        assert r["number"] == sum(1 for g, v, k in made if g == r["g"] and (v, k) < (r["v"], r["k"]))
    for r in columns.average_rank(frame, ["g"], "v", "rank").collect():
        own = [v for g, v, _ in made if g == r["g"]]
        assert r["rank"] == sum(v < r["v"] for v in own) + (sum(v == r["v"] for v in own) + 1) / 2
    found = {r["g"]: r for r in columns.quantiles(frame.filter("g is not null"), ["g"], "v", [0.0, 0.31, 0.5, 1.0], list("pqrs")).collect()}
    for g, r in found.items():
        assert [r[c] for c in "pqrs"] == pytest.approx(np.quantile([v for x, v, _ in made if x == g], [0.0, 0.31, 0.5, 1.0]))
    one = columns.quantiles(frame, [], "v", [0.5], ["m"]).collect()
    assert [r["m"] for r in one] == [np.median([v for _, v, _ in made])]
    assert columns.quantiles(frame.limit(0), [], "v", [0.5], ["m"]).collect()[0]["m"] is None


def test_trend_and_permutation_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(meanvar, "CHUNK_ROWS", 7)
    made = [(i, "a" if i % 3 else "b", float((i * 37) % 101)) for i in range(100)]
    frame = spark.createDataFrame(made, "k int, g string, y double").repartition(4)
    for r in meanvar.rolling_trend(frame, "k", "y", 5, ["g"], "k").collect():
        own = [y for k, g, y in made if g == r["g"] and k <= r["k"]][-5:]
        assert r["trend"] == pytest.approx(np.mean(own))
    mixed = prep.permute_within(frame, ["g"], "y", "k", seed=4).collect()
    for g in "ab":
        assert sorted(r["y"] for r in mixed if r["g"] == g) == sorted(y for _, h, y in made if h == g)
    assert sum(r["y"] != made[r["k"]][2] for r in mixed) > 80


def test_results_too_large_to_list_are_refused(spark, monkeypatch):
    genes = spark.range(10).select(F.col("id").cast("string").alias("gene_id"))
    monkeypatch.setattr(tables, "MOST_PAIRS", 44)
    monkeypatch.setattr(tables, "MOST_LEVELS", 9)
    for call in (lambda: tables.product_pairs(genes, genes), lambda: tables.unordered_pairs(genes), lambda: tables.one_hot(genes, "gene_id")):
        with pytest.raises(ValueError):
            call()


def test_matrix_files_in_several_parts(spark, tmp_path):
    entries = [(g, c, g * 10 + c) for g in range(1, 5) for c in range(1, 31) if (g + c) % 3]
    (tmp_path / "m").mkdir()
    (tmp_path / "c").mkdir()
    lines = [f"{g} {c} {x}" for g, c, x in entries]
    (tmp_path / "m" / "z.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n% a comment\n4 30 80\n" + "\n".join(lines[:20]) + "\n")
    (tmp_path / "m" / "a.mtx").write_text("\n".join(lines[20:]) + "\n")
    (tmp_path / "g.tsv").write_text("".join(f"gene{i}\tname\r\n" for i in range(1, 5)))
    (tmp_path / "c" / "1.tsv").write_text("".join(f"cell{i}\n" for i in range(1, 13)))
    (tmp_path / "c" / "2.tsv").write_text("".join(f"cell{i}\n" for i in range(13, 31)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        found = io.read_mtx(spark, str(tmp_path / "m"), str(tmp_path / "g.tsv"), str(tmp_path / "c")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["gene_id"], r["cell_id"], r["x"]) for r in found) == sorted((f"gene{g}", f"cell{c}", float(x)) for g, c, x in entries)


def test_moments_by_hand(counts, cells):
    sized = groups.total_size_factor(counts, cells)
    assert {r["cell_id"]: r["size_factor"] for r in sized.collect()} == {1: 3, 2: 3, 3: 5, 4: 2, 5: 0}
    found = by_key(estimators.moments(counts, sized), "grp", "gene_id")
    a = found["g1", "a"]
    assert a["n_obs"] == 2 and a["mean"] == pytest.approx((2 / 3 + 1) / 2)
    assert a["var"] == pytest.approx(((4 - 0.9 * 2) / 9 + (9 - 0.9 * 3) / 9) / 2 - a["mean"] ** 2)
    assert found["g2", "c"]["n_obs"] == 2  # the empty cell 5 is left out
    assert ("g1", "c") not in found


def test_adding_a_gene_without_counts_changes_nothing(counts, cells, spark):
    sized = groups.total_size_factor(counts, cells)
    more = counts.union(spark.createDataFrame([(1, "z", 0)], counts.schema))
    one, two = (by_key(estimators.moments(c.repartition(n), sized), "grp", "gene_id") for c, n in ((counts, 1), (more, 5)))
    assert all(two[k]["mean"] == pytest.approx(v["mean"]) for k, v in one.items())


def test_pairs_without_a_common_cell_and_with_themselves(counts, cells, spark):
    sized = groups.total_size_factor(counts, cells)
    pairs = spark.createDataFrame([("a", "b"), ("a", "a"), ("b", "c"), ("a", "none")], "gene_1 string, gene_2 string")
    found = by_key(estimators.pair_covariance(counts, sized, pairs), "grp", "gene_1", "gene_2")
    assert found["g1", "a", "b"]["cov"] == pytest.approx((2 / 3 * 1 / 3) / 2 - 5 / 6 * 1 / 6)
    one = by_key(estimators.moments(counts, sized), "grp", "gene_id")
    assert found["g1", "a", "a"]["cov"] == pytest.approx(one["g1", "a"]["var"])
    assert found["g2", "b", "c"]["cov"] == pytest.approx(-one["g2", "b"]["mean"] * one["g2", "c"]["mean"])
    assert not any("none" in k for k in found)
    with pytest.raises(ValueError):
        estimators.pair_covariance(counts, sized, pairs, kind="mean_only")


def test_own_estimators_and_unknown_ones(counts, cells):
    sized = groups.total_size_factor(counts, cells)
    own = estimators.EstimatorSpec(lambda: (F.col("total") / F.col("n_obs"), F.lit(1.0)), lambda x, w, inverse, n, q: (x @ w / n, np.ones(w.shape[1])))
    assert by_key(estimators.moments(counts, sized, kind=own), "grp", "gene_id")["g1", "a"]["mean"] == 2.5
    with pytest.raises(ValueError):
        estimators.get_estimator("nothing")


def test_validation(counts, cells, spark):
    assert groups.validate(counts, cells) == {"empty_cells": 1}
    for bad_counts, bad_cells in ((counts, cells.withColumn("q", F.lit(1.0))), (counts.union(counts), cells), (counts.withColumn("x", -F.col("x")), cells)):
        with pytest.raises(ValueError):
            groups.validate(bad_counts, bad_cells)


def test_compression_adds_up(counts, cells):
    sized = groups.bin_size_factor(groups.total_size_factor(counts, cells), 3)
    genes = counts.join(cells, "cell_id").select("grp", "gene_id").distinct()
    found = groups.compress(counts, sized, genes)
    sums = by_key(found.groupBy("grp", "gene_id").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("x")).alias("x")), "grp", "gene_id")
    assert all(r["n"] == (2 if g == "g1" else 3) for (g, _), r in sums.items())
    assert sums["g2", "b"]["x"] == 4


def test_one_size_factor_and_labels_with_the_delimiter(spark):
    cells = spark.createDataFrame([(i, "x^y", 0.1, 2.0) for i in range(12)], "cell_id bigint, label string, q double, size_factor double")
    assert {r["sf_bin"] for r in groups.bin_size_factor(cells).collect()} == {2.0}
    grouped, table = groups.create_groups(cells, ["label"])
    assert table.first()["label"] == "x^y" and grouped.count() == 12
    assert groups.create_groups(cells, ["label"], min_cell_count=13)[0].count() == 0


def test_labels_that_look_alike_are_groups_of_their_own(spark):
    labels = [("a^b", "c"), ("a", "b^c"), (None, "z"), ("", "z"), ("%n", "z"), ("a%d", "b"), ("a^", "b"), ("%", "p")]
    cells = spark.createDataFrame([(10 * k + i, *pair, 0.1) for k, pair in enumerate(labels) for i in range(3)], "cell_id bigint, one string, two string, q double")
    grouped, table = groups.create_groups(cells, ["one", "two"], min_cell_count=3)
    assert table.select("grp").distinct().count() == len(labels) and {(r["one"], r["two"]) for r in table.collect()} == set(labels)
    assert grouped.groupBy("grp").agg(F.count_distinct("one", "two").alias("n"), F.count("*").alias("c")).filter("c <> 3").count() == 0
    back = groups.split_group_names(table, ["one", "two"])
    assert {tuple(r)[1:] for r in back.collect()} == set(labels)
    with pytest.raises(ValueError):
        groups.create_groups(cells, ["one"], delimiter="%")


def test_resampling_matches_drawing_cells():
    rng = np.random.default_rng(0)
    x = rng.poisson(2, 300).astype(float)
    values, n = np.unique(x, return_counts=True)
    (means,) = bootstrap.resample(bootstrap.generator(1, "g"), n, 4000, lambda w: (values @ w / n.sum(),))
    plain = np.array([rng.choice(x, 300).mean() for _ in range(4000)])
    assert means.mean() == pytest.approx(x.mean(), abs=5 * x.std() / math.sqrt(300 * 4000))
    assert means.std() == pytest.approx(plain.std(), rel=0.1)


def test_resampling_in_chunks_and_of_one_row(monkeypatch):
    n = np.array([5, 7, 9])
    monkeypatch.setattr(bootstrap, "CHUNK", 30)
    (a,) = bootstrap.resample(bootstrap.generator(1, "g"), n, 55, lambda w: (w.sum(axis=0),))
    assert len(a) == 55 and (a == 21).all()
    (b,) = bootstrap.resample(bootstrap.generator(1, "g"), n[:1], 4, lambda w: (w.sum(axis=0),))
    assert np.isnan(b).all()


def test_effects_equal_weighted_regression():
    rng = np.random.default_rng(3)
    t, c, w = rng.integers(0, 2, 12).astype(float), rng.normal(size=(12, 2)), rng.uniform(1, 5, 12)
    y = 2 * t + c @ [1.0, -1.0] + rng.normal(size=12)
    x = np.column_stack([np.ones(12), c, t])
    want = np.linalg.solve((x * w[:, None]).T @ x, (x * w[:, None]).T @ y)[-1]
    assert bootstrap.effects(y[:, None], t[:, None], c, w)[0, 0] == pytest.approx(want)
    ones = bootstrap.effects(y[:, None], np.ones((12, 1)), c, w)
    assert ones[0, 0] == pytest.approx(np.average(y, weights=w))


def test_filling_and_sums_of_units(monkeypatch):
    filled = bootstrap.fill_invalid(np.array([1.0, np.nan, 2.0]), np.array([False, True, False]), np.random.default_rng(0))
    assert filled[1] in (1.0, 2.0)
    assert bootstrap.fill_invalid(np.array([np.nan]), np.array([True]), np.random.default_rng(0)) is None
    bad = np.array([True, False, True, False, True])
    assert bootstrap.fill_invalid(np.array([0.0, 1.0, 0.0, 2.0, 0.0]), bad, None).tolist() == [1.0, 1.0, 2.0, 2.0, 1.0]
    monkeypatch.setattr(bootstrap, "UNIT", 4)
    draws = np.random.default_rng(1).normal(1, 1, (2, 10))
    draws[0, 3] = np.nan
    n, mean, m2, beyond = bootstrap.unit_sums(draws, np.array([0.5, 1.0]))
    assert n.tolist() == [[3, 4, 2], [4, 4, 2]] and np.allclose((n * mean).sum(axis=1), np.nansum(draws, axis=1))
    assert np.allclose(m2[1, :2], [4 * draws[1, :4].var(), 4 * draws[1, 4:8].var()])
    assert beyond.sum(axis=1).tolist() == [int((abs(draws[0] - 0.5) > 0.5).sum()), int((abs(draws[1] - 1) > 1).sum())]


def test_zeros_are_drawn_together():
    n, inverse, x = bootstrap.alike(np.array([3, 5, 2, 7, 0]), np.array([0.5, 1.0, 2.0, 4.0, 1.0]), np.array([0.0, 1.0, 0.0, 2.0, 3.0]))
    assert n.tolist() == [7, 5, 5] and x.tolist() in ([2.0, 0.0, 1.0], [2.0, 1.0, 0.0]) and inverse[0] == 4.0


def test_poisson_regression_recovers_its_coefficients():
    rng = np.random.default_rng(1)
    x = np.column_stack([np.ones(400), rng.integers(0, 2, 400)])
    offset = np.log(rng.uniform(50, 100, 400))
    beta, _ = bootstrap.loglinear(rng.poisson(np.exp(x @ [0.5, 0.3] + offset)).astype(float), x, offset)
    assert beta == pytest.approx([0.5, 0.3], abs=0.03)


@pytest.fixture(scope="module")
def simulated(spark):
    rng = np.random.default_rng(5)
    rows, people = [], []
    for cell in range(240):
        stim = cell % 2
        people.append((cell, stim, cell % 3, 0.2))
        size = rng.uniform(0.7, 1.3)
        for g in range(20):
            mean = (1.0 + g / 4) * size * (2.0 if g == 0 and stim else 1.0)
            x = rng.negative_binomial(3, 3 / (3 + mean))
            if x:
                rows.append((cell, f"g{g:02}", int(x)))
    return spark.createDataFrame(rows, "cell_id bigint, gene_id string, x bigint"), spark.createDataFrame(people, "cell_id bigint, stim int, rep int, q double")


def test_planted_effect_is_found_and_runs_agree(simulated):
    counts, cells = simulated
    run = lambda c: analysis.binary_test_1d(c, cells, "stim", num_boot=300, trim_percent=0.5).orderBy("gene").toPandas()
    found = run(counts)
    assert found.loc[found["gene"] == "g00", "de_pval"].iloc[0] < 1e-6
    assert (found.loc[found["gene"] != "g00", "de_fdr"] < 0.01).sum() <= 1
    again = run(counts.repartition(3))
    pd.testing.assert_frame_equal(found, again, rtol=1e-6)


def test_one_sample_and_replicates(simulated):
    counts, cells = simulated
    a = analysis.analyse(counts, cells, ["rep"], trim_percent=0.5)
    design = analysis.design_of(a, ["rep"]).assign(one=1.0)
    found = testing.ht_1d(a.parameters, a.compressed, design, ["one"], num_boot=100).toPandas()
    logs = meanvar.moments_1d(a.moments, a.groups, "ALL").toPandas().set_index("gene_id")
    got = found.set_index("gene")["de_coef"]
    assert np.allclose(got, logs.loc[got.index, "log_mean"], atol=0.05)
    hierarchical = testing.ht_1d(a.parameters, a.compressed, design.assign(t=design["rep"] == 1), ["t"], num_boot=100, resample_groups=True)
    assert hierarchical.count() == len(found)


@pytest.mark.parametrize("kind", ["hyper_relative", "poi_absolute", "naive"])
def test_correlation_test_draws_what_it_observes(simulated, spark, kind):
    """Observed coefficients by numpy over all cells, and errors of drawing cells anew."""
    counts, cells = simulated
    pairs = spark.createDataFrame([("g03", "g04"), ("g10", "g15"), ("g07", "g07")], "gene_1 string, gene_2 string")
    found = analysis.binary_test_2d(counts, cells, pairs, "stim", num_boot=400, trim_percent=0.5, kind=kind, num_bins=2000).toPandas().set_index("gene_1")
    a = analysis.analyse(counts, cells, ["stim"], kind=kind, trim_percent=0.5, min_share=0.9)
    size = a.cells.select("cell_id", "stim", "size_factor").toPandas().set_index("cell_id")
    x = counts.toPandas().pivot(index="cell_id", columns="gene_id", values="x").reindex(size.index).fillna(0.0)
    s = np.ones(len(size)) if kind == "poi_absolute" else size["size_factor"].to_numpy()
    q = {"hyper_relative": 0.2, "poi_absolute": 0.0, "naive": 1.0}[kind]

    def corr(rows, one, two):
        u, v, t = x[one].to_numpy()[rows], x[two].to_numpy()[rows], s[rows]
        var = [np.mean((w * w - (1 - q) * w) / t**2) - np.mean(w / t) ** 2 for w in (u, v)]
        return (np.mean(u * v / t**2) - np.mean(u / t) * np.mean(v / t)) / np.sqrt(var[0] * var[1])

    rng, stim = np.random.default_rng(1), size["stim"].to_numpy()
    for one, two in (("g03", "g04"), ("g10", "g15")):
        parts = [np.flatnonzero(stim == i) for i in (0, 1)]
        assert found.loc[one, "corr_coef"] == pytest.approx(corr(parts[1], one, two) - corr(parts[0], one, two))
        drawn = [corr(rng.choice(parts[1], len(parts[1])), one, two) - corr(rng.choice(parts[0], len(parts[0])), one, two) for _ in range(400)]
        assert found.loc[one, "corr_se"] == pytest.approx(np.nanstd(drawn), rel=0.2)
    assert pd.isna(found.loc["g07", "corr_coef"])


@pytest.fixture(scope="module")
def unbalanced(simulated):
    """Groups of unequal size whose replicates go along with the treatment."""
    counts, cells = simulated
    uneven = cells.withColumn("rep", F.when(F.col("stim") == 1, F.greatest("rep", F.lit(1))).otherwise(F.least("rep", F.lit(1)) * (F.col("rep") % 2)))
    a = analysis.analyse(counts, uneven, ["stim", "rep"], trim_percent=0.5, min_cell_count=1)
    design = analysis.design_of(a, ["stim", "rep"]).assign(one=lambda f: (f["rep"] == 1) * 1.0, two=lambda f: (f["rep"] == 2) * 1.0)
    return a, design


def by_numpy(a, design, gene, covs, column="mean"):
    """The weighted slope of the log on the treatment beside covariates."""
    own = a.parameters.filter(F.col("gene_id") == gene).toPandas().set_index("grp").loc[design["grp"]]
    x, w = np.column_stack([np.ones(len(design)), design[[*covs, "stim"]]]), own["n_cells"].to_numpy(dtype=float)
    return np.linalg.lstsq(x * np.sqrt(w)[:, None], np.log(own[column].to_numpy()) * np.sqrt(w), rcond=None)[0][-1]


def test_treatments_and_covariates_of_each_gene_and_pair(unbalanced, spark):
    a, design = unbalanced
    some = spark.createDataFrame([("g01", []), ("g02", ["one"])], "gene_id string, covariates array<string>")
    observed = testing.ht_1d(a.parameters, a.compressed, design, ["stim"], ["one", "two"], num_boot=0, covariates_for=some).toPandas().set_index("gene")
    for gene, covs in (("g01", []), ("g02", ["one"]), ("g05", ["one", "two"])):
        for column, stat in (("mean", "de_coef"), ("res_var", "dv_coef")):
            assert observed.loc[gene, stat] == pytest.approx(by_numpy(a, design, gene, covs, column))
            assert abs(by_numpy(a, design, gene, covs, column) - by_numpy(a, design, gene, [] if covs else ["one", "two"], column)) > 1e-4
    run = lambda covs, **more: testing.ht_1d(a.parameters, a.compressed, design, ["stim"], covs, num_boot=20, **more).toPandas().set_index("gene").sort_index()
    without, both = run([]), run(["one", "two"])
    mixed = run(["one", "two"], covariates_for=some)
    assert mixed.loc["g01"].equals(without.loc["g01"]) and mixed.loc["g05"].equals(both.loc["g05"])
    assert mixed.loc["g02"].equals(run(["one"]).loc["g02"]) and not mixed.loc["g01"].equals(both.loc["g01"])

    pairs = spark.createDataFrame([("g03", "g04"), ("g10", "g15")], "gene_1 string, gene_2 string")
    params, compressed = analysis.pair_analysis(a, pairs)
    test = lambda **more: testing.ht_2d(params, compressed, design, covariates=["one", "two"], num_boot=20, **more).toPandas().set_index(["gene_1", "tx"]).sort_index()
    ordered = design.sort_values("grp")
    stim, rep = ordered["stim"].astype(float).tolist(), ordered["rep"].astype(float).tolist()
    own = spark.createDataFrame([("g03", "g04", "stim", stim), ("g10", "g15", "stim", stim), ("g10", "g15", "rep", rep)], "gene_1 string, gene_2 string, tx string, dose array<double>")
    plain, listed = test(treatments=["stim"]), test(tests=own)
    assert listed.loc[("g03", "stim")].equals(plain.loc[("g03", "stim")]) and len(listed) == 3 and np.allclose(listed.loc[("g10", "stim"), "corr_coef"], plain.loc[("g10", "stim"), "corr_coef"])
    none = spark.createDataFrame([("g03", "g04", [])], "gene_1 string, gene_2 string, covariates array<string>")
    bare = testing.ht_2d(params, compressed, design, ["stim"], num_boot=20).toPandas().set_index(["gene_1", "tx"])
    assert test(treatments=["stim"], covariates_for=none).loc[("g03", "stim")].equals(bare.loc[("g03", "stim")])
    assert not plain.loc[("g03", "stim")].equals(bare.loc[("g03", "stim")])

    summary = testing.mean_summary(a.parameters, a.compressed, 30)
    totals = spark.createDataFrame([(g, 1000.0) for g in design["grp"]], "grp string, total double")
    mean = lambda covs, **more: testing.ht_mean(summary, totals, design, ["stim"], covs, **more).toPandas().set_index("gene_id")["coef"]
    assert mean(["one", "two"], covariates_for=some)["g01"] == pytest.approx(mean([])["g01"])


def test_estimators_without_draws_or_pairs(simulated, spark):
    counts, cells = simulated
    a = analysis.analyse(counts, cells, ["stim"], kind="good_mean_only", trim_percent=0.5)
    want = by_key(estimators.good_turing_mean(counts, a.cells, counts.select("gene_id").distinct(), ["grp"]), "grp", "gene_id")
    assert all(r["mean"] == pytest.approx(want[k]["mean"]) and r["var"] == 10 for k, r in by_key(a.moments, "grp", "gene_id").items())
    with pytest.raises(ValueError, match="point values"):
        testing.ht_1d(a.parameters, a.compressed, analysis.design_of(a, ["stim"]), ["stim"], kind="good_mean_only")
    pairs = spark.createDataFrame([("g03", "g04"), ("g05", "g05")], "gene_1 string, gene_2 string")
    hyper = estimators.get_estimator("hyper_relative")
    with pytest.raises(ValueError, match="covariance"):
        estimators.pair_covariance(counts, a.cells, pairs, kind=estimators.EstimatorSpec(hyper.point, hyper.boot))
    run = lambda kind: analysis.binary_test_2d(counts, cells, pairs, "stim", num_boot=30, trim_percent=0.5, kind=kind).orderBy("gene_1").toPandas()
    own = estimators.EstimatorSpec(hyper.point, hyper.boot, cov=hyper.cov, cov_boot=hyper.cov_boot, zeros_alike=True)
    pd.testing.assert_frame_equal(run(own), run("hyper_relative"))


def test_bootstrap_errors_of_means(simulated):
    counts, cells = simulated
    a = analysis.analyse(counts, cells, ["stim"], trim_percent=0.5, num_bins=5000)
    found = testing.mean_summary(a.parameters, a.compressed, 600).toPandas().set_index(["grp", "gene_id"])
    size = a.cells.select("cell_id", "grp", "size_factor").toPandas().set_index("cell_id")
    x = counts.toPandas().pivot(index="cell_id", columns="gene_id", values="x").reindex(size.index).fillna(0.0)
    ratio = []
    for (grp, gene), r in found.iterrows():
        own = size["grp"] == grp
        v = x[gene][own] / size["size_factor"][own]
        assert r["mean"] == pytest.approx(v.mean(), abs=0.4 * v.std() / math.sqrt(len(v)))
        ratio.append(r["sem"] / (v.std() / math.sqrt(len(v))))
        assert r["se_log"] == pytest.approx(r["sem"] / r["mean"], rel=0.15)
    assert np.mean(ratio) == pytest.approx(1, abs=0.03) and max(abs(np.array(ratio) - 1)) < 0.2


def test_quasi_likelihood_by_numpy(spark):
    rng = np.random.default_rng(6)
    groups_ = [f"s{i}" for i in range(8)]
    design = pd.DataFrame({"grp": groups_, "t": [0.0, 1.0] * 4, "c": rng.normal(size=8)})
    total = rng.uniform(500, 900, 8)
    made, fits = [], {}
    for gene in ("a", "b", "d"):
        mean, sem = rng.uniform(0.5, 2.0, 8), rng.uniform(0.01, 0.05, 8)
        made += [(g, gene, float(m), float(s)) for g, m, s in zip(groups_, mean, sem)]
        x = np.column_stack([np.ones(8), design["c"], design["t"]])
        beta = np.zeros(3)
        for _ in range(200):  # Newton steps of the Poisson likelihood
            mu = np.exp(x @ beta) * total
            beta = beta + np.linalg.solve(x.T @ (x * mu[:, None]), x.T @ (mean * total - mu))
        fits[gene] = (x, beta, np.exp(x @ beta) * total, mean * total, (sem * total) ** 2)
    slopes = [np.polyfit(np.log10(mu), np.log10((mu - y) ** 2), 1)[0] for _, _, mu, y, _ in fits.values()]
    power = 0.25 * min(max(np.mean(slopes), 0), 2) + 0.75 * 2
    summary = spark.createDataFrame(made, "grp string, gene_id string, mean double, sem double")
    totals = spark.createDataFrame(list(zip(groups_, map(float, total))), "grp string, total double")
    for r in testing.ht_mean(summary, totals, design, ["t"], ["c"]).collect():
        x, beta, mu, _, spread = fits[r["gene_id"]]
        se = math.sqrt(np.linalg.inv(x.T @ (x * (mu**2 / (spread + mu**power))[:, None]))[-1, -1])
        assert (r["coef"], r["se"]) == (pytest.approx(beta[-1], rel=1e-6), pytest.approx(se, rel=1e-6))
        assert r["pval"] == pytest.approx(math.erfc(abs(beta[-1] / se) / math.sqrt(2)), rel=1e-6)


def test_meta_analysis_and_weighted_logs_by_numpy(spark):
    rng = np.random.default_rng(8)
    made = [(b, t, g, 50 if (b, g) != (2, "y") else 5, float(rng.uniform(1, 3)), float(rng.uniform(0.05, 0.2))) for b in range(4) for t in (0, 1) for g in ("x", "y", "z")]
    cube = spark.createDataFrame(made, "b int, t int, gene_id string, n_obs int, mean double, sem double")
    for r in testing.meta_wls(cube, "t", "b").collect():
        rows = [m for m in made if m[2] == r["gene_id"] and m[3] > 20]
        gap = [next(math.log(m[4]) for m in rows if m[:2] == (b, 1)) - next(math.log(m[4]) for m in rows if m[:2] == (b, 0)) for b in {m[0] for m in rows}]
        assert r["coef"] == pytest.approx(np.mean(gap)) and r["se"] == pytest.approx(math.sqrt(sum((m[5] / m[4]) ** 2 for m in rows)) / len(gap))
        assert r["pval"] == pytest.approx(math.erfc(abs(r["coef"] / r["se"]) / math.sqrt(2)))
    assert {r["gene_id"] for r in testing.meta_wls(cube, "t", "b").collect()} == {"x", "y", "z"}
    groups_ = cube.withColumn("grp", F.concat_ws("_", "b", "t"))
    design = pd.DataFrame([(f"{b}_{t}", float(t), float(b == 1)) for b in range(4) for t in (0, 1)], columns=["grp", "t", "c"])
    for r in testing.log1p_wls(groups_, design, ["t"], ["c"]).collect():
        rows = sorted((f"{m[0]}_{m[1]}", m[1], m[0] == 1, m[4], m[5]) for m in made if m[2] == r["gene_id"])
        x = np.array([[1.0, c, t] for _, t, c, _, _ in rows])
        y, se = np.array([math.log1p(m) for *_, m, _ in rows]), np.array([(math.log1p(m + s) - math.log1p(m - s)) / 2 for *_, m, s in rows])
        inverse = np.linalg.inv((x / se[:, None] ** 2).T @ x)
        assert r["coef"] == pytest.approx((inverse @ (x / se[:, None] ** 2).T @ y)[-1]) and r["se"] == pytest.approx(math.sqrt(inverse[-1, -1]))


@pytest.mark.parametrize("n_covariates", [0, 3])
def test_association_equals_least_squares(spark, n_covariates):
    rng = np.random.default_rng(n_covariates)
    people = [f"p{i}" for i in range(30)]
    c, g, y = rng.normal(size=(30, n_covariates)), rng.integers(0, 3, (30, 4)).astype(float), rng.normal(size=(30, 3))
    long = lambda m, name, key: spark.createDataFrame([(f"{key}{j}", p, float(m[i, j])) for i, p in enumerate(people) for j in range(m.shape[1])], f"{name} string, individual string, value double")
    genotypes = long(g, "snp", "s").withColumnRenamed("value", "dosage")
    covariates = long(c, "name", "c") if n_covariates else None
    pairs = spark.createDataFrame([(f"g{i}", f"s{j}") for i in range(3) for j in range(4)], "gene_id string, snp string")
    found = testing.cis_association(long(y, "gene_id", "g"), genotypes, pairs, covariates).collect()
    assert len(found) == 12
    for r in found:
        x = np.column_stack([np.ones(30), c, g[:, int(r["snp"][1:])]])
        target = y[:, int(r["gene_id"][1:])]
        beta = np.linalg.lstsq(x, target, rcond=None)[0]
        df = 30 - x.shape[1]
        se = math.sqrt(((target - x @ beta) ** 2).sum() / df * np.linalg.inv(x.T @ x)[-1, -1])
        assert (r["beta"], r["t"], r["df"]) == (pytest.approx(beta[-1]), pytest.approx(beta[-1] / se), df)
        assert r["pval"] == pytest.approx(special.two_sided_t(beta[-1] / se, df)[0]) and r["fdr"] >= r["pval"]
    with pytest.raises(ValueError):
        testing.cis_association(long(y, "gene_id", "g").filter("individual <> 'p3'"), genotypes, pairs)


def test_eqtl_finds_a_planted_effect(spark):
    rng = np.random.default_rng(9)
    rows, people, doses = [], [], {f"p{i}": float(i % 3) for i in range(12)}
    for cell in range(600):
        p = f"p{cell % 12}"
        people.append((cell, p))
        for k in range(12):
            mean = (1 + k / 4) * (1 + 2 * doses[p] if k == 0 else 1)
            x = rng.poisson(mean * 0.3 * rng.uniform(0.8, 1.2))
            if x:
                rows.append((cell, f"g{k:02}", int(x)))
    counts, cells = spark.createDataFrame(rows, "cell_id bigint, gene_id string, x bigint"), spark.createDataFrame(people, "cell_id bigint, individual string")
    genotypes = spark.createDataFrame([(p, "s", v) for p, v in doses.items()], "individual string, snp string, dosage double")
    covariates = spark.createDataFrame([(p, "a", float(rng.normal())) for p in doses], "individual string, name string, value double")
    pairs = spark.createDataFrame([(f"g{k:02}", "s") for k in range(12)], "gene_id string, snp string")
    found = analysis.run_eqtl(counts, cells, genotypes, covariates, pairs, num_boot=300, trim_percent=0.5).toPandas().set_index("gene")
    assert found.loc["g00", "de_pval"] == found["de_pval"].min() and found.loc["g00", "de_pval"] < 1e-2 and found.loc["g00", "de_coef"] > 0.02


def test_cells_genotypes_and_covariates_must_agree(simulated, spark):
    counts, cells = simulated
    people = cells.withColumn("individual", F.col("rep").cast("string"))
    genotypes = spark.createDataFrame([("0", "s", 1.0), ("1", "s", 0.0)], "individual string, snp string, dosage double")
    covariates = spark.createDataFrame([(str(i), "a", 1.0 * i) for i in range(3)], "individual string, name string, value double")
    with pytest.raises(ValueError):
        analysis.run_eqtl(counts, people, genotypes, covariates, spark.createDataFrame([("g00", "s")], "gene_id string, snp string"))


def test_missing_and_tied_p_values(spark):
    rows = spark.createDataFrame([(1, 0.01), (2, 0.01), (3, float("nan")), (4, None), (5, 0.5), (6, 1.0)], "k int, pval double")
    found = {r["k"]: r["fdr"] for r in pvalues.bh_fdr(rows).collect()}
    assert found == {1: 0.02, 2: 0.02, 3: 1.0, 4: 1.0, 5: pytest.approx(2 / 3), 6: 1.0}
    assert {r["qvalue"] for r in pvalues.storey_qvalue(rows.filter("k > 4"), pi0=0.5).collect()} == {0.5}
    assert pvalues.bh_fdr(rows.limit(0)).count() == 0


def test_closest_without_neighbours_and_across_bins(spark):
    a = spark.createDataFrame([("c", 500, 501, "x"), ("d", 1, 2, "y"), ("c", 10, 11, "z")], "chrom string, start bigint, end bigint, name string")
    b = spark.createDataFrame([("c", 5, 12, "far"), ("c", 900, 950, "right")], a.schema)
    found = {r["a_name"]: (r["b_name"], r["distance"]) for r in intervals.interval_closest(a, b, width=10).collect()}
    assert found == {"x": ("right", 400), "y": (None, None), "z": ("far", 0)}


def test_small_helpers(spark, counts):
    rows = spark.createDataFrame([(1, "p|q"), (2, None)], "i int, s string")
    assert [r[0] for r in rows.orderBy("i").select(prep.split_label("s", "|", 1)).collect()] == ["q", None]
    assert prep.explode_list(rows, "s", "|", "part").count() == 2
    hot = tables.one_hot(counts, "gene_id")
    assert hot.columns[-2:] == ["gene_id_b", "gene_id_c"]
    x = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(6)] + [(float("nan"), 1.0), (1.0, None)], "x double, y double").withColumn("k", F.lit(1))
    fit = meanvar.robust_linregress(x, "x", "y", ["k"]).first()
    assert (fit["slope"], fit["intercept"], fit["r"], fit["spearman"]) == (pytest.approx(2), pytest.approx(1), pytest.approx(1), pytest.approx(1))


# Draws in blocks, products in tiles


def test_blocks_of_draws_change_no_number(unbalanced):
    a, design = unbalanced
    params, compressed = materialize(a.parameters), materialize(a.compressed)
    for more in ({}, {"resample_groups": True}, {"approx": "boot"}):
        run = lambda block: testing.ht_1d(params, compressed, design, ["stim"], ["one"], num_boot=350, block=block, **more).orderBy("gene").collect()  # noqa: B023, E731
        whole = run(None)
        assert whole == run(100) == run(300) and all(r["de_pval"] is not None for r in whole)
    with pytest.raises(ValueError, match="multiple"):
        testing.ht_1d(params, compressed, design, ["stim"], num_boot=350, block=150)


class Peak(threading.Thread):
    """MB of the largest Python worker while it runs."""

    def __init__(self):
        super().__init__(daemon=True)
        self.mb, self.over = 0.0, False

    def run(self):
        psutil = pytest.importorskip("psutil")
        while not self.over:
            for p in psutil.Process().children(recursive=True):
                try:
                    if "pyspark" in " ".join(p.cmdline()) and "java" not in p.name():
                        self.mb = max(self.mb, p.memory_info().rss / 1e6)
                except psutil.Error:
                    pass
            time.sleep(0.05)


def test_thousands_of_groups_and_draws_in_bounded_memory(spark):
    """5,000 groups x 5,000 draws: 400 MB if they were held at once."""
    n, draws_ = 5000, 5000
    known = spark.range(n).select(F.format_string("g%05d", "id").alias("grp"), F.lit("a").alias("gene_id"), F.lit(0.7).alias("mean"), F.lit(1.0).alias("res_var"), F.lit(40).alias("n_cells"), F.lit(0.1).alias("q"), *[F.lit(0.0).alias(c) for c in ("center", "c0", "c1", "c2")])
    rows = known.select("grp", "gene_id", F.lit(1.0).alias("sf_bin"), F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(c).cast("long").alias("n")) for x, c in ((0, 20), (1, 15), (3, 5))])).alias("v")).select("grp", "gene_id", "sf_bin", "v.*")
    design = pd.DataFrame({"grp": [f"g{i:05}" for i in range(n)], "t": [float(i % 2) for i in range(n)]})
    peak = Peak()
    peak.start()
    found = testing.ht_1d(known, rows, design, ["t"], num_boot=draws_, resample_groups=True).collect()
    peak.over = True
    peak.join()
    assert len(found) == 1 and abs(found[0]["de_coef"]) < 0.02 and found[0]["de_se"] > 0
    assert 0 < peak.mb < 1000


def test_products_of_thousands_of_features(spark):
    rng = np.random.default_rng(8)
    features, people = 5000, 300
    entries = rng.random((people, features)) < 0.01
    x = entries * rng.integers(1, 5, (people, features))
    cell, feature = np.nonzero(entries)
    path = spark.createDataFrame(pd.DataFrame({"cell_id": cell, "gene_id": np.char.add("f", feature.astype(str)), "x": x[cell, feature]}))
    cells_ = spark.createDataFrame(pd.DataFrame({"cell_id": np.arange(people), "grp": np.where(np.arange(people) % 3 == 0, "u", "v"), "q": 0.1, "size_factor": 1.0 + np.arange(people) % 4}))
    values = path.join(cells_, "cell_id").select("cell_id", "gene_id", (F.col("x") / F.col("size_factor")).alias("v"))
    peak = Peak()
    peak.start()
    found = materialize(products.pair_products(values, cells_.select("cell_id", "grp"), ["grp"]))
    peak.over = True
    peak.join()
    v = x / (1.0 + np.arange(people) % 4)[:, None]
    whole = {g: v[rows].T @ v[rows] for g, rows in (("u", np.arange(people) % 3 == 0), ("v", np.arange(people) % 3 != 0))}
    got = {r["grp"]: r for r in found.groupBy("grp").agg(F.count("*").alias("n"), F.sum("prod").alias("s"), F.sum(F.col("prod") ** 2).alias("ss")).collect()}
    for g, m in whole.items():
        upper = np.triu(m)
        assert got[g]["s"] == pytest.approx(upper.sum()) and got[g]["ss"] == pytest.approx((upper**2).sum()) and got[g]["n"] <= features * (features + 1) / 2
    assert 0 < peak.mb < 1000
    listed = spark.createDataFrame([(f"f{i}", f"f{j}") for i, j in ((1, 2), (2, 1), (7, 7), (4999, 0))], "gene_1 string, gene_2 string")
    some = {(r["grp"], r["gene_1"], r["gene_2"]): r["prod"] for r in products.pair_products(values, cells_.select("cell_id", "grp"), ["grp"], listed).collect()}
    for g, m in whole.items():
        for i, j in ((1, 2), (2, 1), (7, 7), (4999, 0)):
            assert some.get((g, f"f{i}", f"f{j}"), 0.0) == pytest.approx(m[i, j])


def test_joint_counts_either_way(spark):
    rng = np.random.default_rng(9)
    x = rng.poisson(0.7, (60, 6))
    cell, gene = np.nonzero(x)
    counts_ = spark.createDataFrame([(int(c), f"g{g}", int(x[c, g])) for c, g in zip(cell, gene)], "cell_id bigint, gene_id string, x bigint")
    cells_ = spark.createDataFrame([(i, "u" if i % 2 else "v", 1.0 + i % 3) for i in range(60)], "cell_id bigint, grp string, sf_bin double")
    for pairs_ in ([("g0", "g1")], [(f"g{i}", f"g{j}") for i in range(6) for j in range(6)], [("g0", "none"), ("none", "other")]):
        found = groups.compress_pairs(counts_, cells_, spark.createDataFrame(pairs_, "gene_1 string, gene_2 string")).collect()
        column = lambda g: x[:, int(g[1])] if g[1:].isdigit() else np.zeros(60, dtype=int)
        want = Counter(("u" if i % 2 else "v", a, b, 1.0 + i % 3, int(column(a)[i]), int(column(b)[i])) for a, b in pairs_ for i in range(60))
        assert {(r["grp"], r["gene_1"], r["gene_2"], r["sf_bin"], r["x1"], r["x2"]): r["n"] for r in found} == dict(want)


def test_meta_analysis_of_thousands_of_blocks(spark):
    rng = np.random.default_rng(10)
    rows = pd.DataFrame({"gene_id": "a", "b": np.repeat(np.arange(3000), 3), "t": np.tile([0, 1, 1], 3000), "n_obs": 50, "mean": rng.uniform(1, 2, 9000), "sem": rng.uniform(0.1, 0.3, 9000)})
    rows.loc[rows["t"] == 1, "mean"] *= 1.5
    (found,) = testing.meta_wls(spark.createDataFrame(rows), "t", "b").collect()
    assert found["coef"] == pytest.approx(math.log(1.5), abs=0.02) and 0 < found["se"] < 0.02 and found["pval"] < 1e-9


def test_a_million_associations_in_tiles(spark):
    rng = np.random.default_rng(11)
    genes, snps, people = 1000, 1000, 100
    y, g = rng.normal(size=(genes, people)), rng.integers(0, 3, (snps, people)).astype(float)
    y[5] += 2 * g[7]
    long = lambda m, key, value: spark.createDataFrame(pd.DataFrame({key: np.repeat(np.char.add(key[0], np.arange(len(m)).astype(str)), people), "individual": np.tile(np.arange(people).astype(str), len(m)), value: m.ravel()}))
    expression, genotypes = long(y, "gene_id", "value"), long(g, "snp", "dosage")
    pairs_ = expression.select("gene_id").distinct().crossJoin(genotypes.select("snp").distinct())
    found = materialize(testing.pseudobulk_linear(expression, genotypes, pairs_))
    assert found.count() == genes * snps
    yc, gc = y - y.mean(axis=1, keepdims=True), g - g.mean(axis=1, keepdims=True)
    want = (yc @ gc.T) / (gc * gc).sum(axis=1)
    for r in found.filter("gene_id in ('g5', 'g17') and snp in ('s7', 's0', 's999')").collect():
        assert r["beta"] == pytest.approx(want[int(r["gene_id"][1:]), int(r["snp"][1:])]) and r["df"] == people - 2
    assert found.agg(F.sum(F.abs("beta")).alias("b")).first()["b"] == pytest.approx(np.abs(want).sum())


def test_associations_with_missing_values(spark):
    rng = np.random.default_rng(12)
    made = [(f"g{k}", str(i), float(rng.normal())) for k in range(3) for i in range(20) if (k, i) != (1, 3)]
    doses = [(f"s{k}", str(i), float(rng.integers(0, 3))) for k in range(2) for i in range(20) if (k, i) != (0, 5)]
    expression = spark.createDataFrame(made, "gene_id string, individual string, value double")
    genotypes = spark.createDataFrame(doses, "snp string, individual string, dosage double")
    pairs_ = spark.createDataFrame([("g0", "s1"), ("g1", "s0"), ("g2", "s0"), ("g9", "s0")], "gene_id string, snp string")
    found = {(r["gene_id"], r["snp"]): r for r in testing.pseudobulk_linear(expression, genotypes, pairs_).collect()}
    assert set(found) == {("g0", "s1"), ("g1", "s0"), ("g2", "s0")} and [found[k]["df"] for k in sorted(found)] == [18, 16, 17]
    y, g = (np.array([v for n, _, v in rows if n == name]) for rows, name in ((made, "g0"), (doses, "s1")))
    assert found["g0", "s1"]["beta"] == pytest.approx(np.polyfit(g, y, 1)[0])


@pytest.mark.parametrize("length", [1, 40])
def test_dense_regions_meet_few_that_do_not_overlap(spark, length):
    """A third of all intervals in one bin: what is compared is at most twice what overlaps, and a share of the intervals."""
    rng = np.random.default_rng(length)
    place = np.where(np.arange(3000) % 3 == 0, rng.integers(0, 900, 3000), rng.integers(0, 3_000_000, 3000))
    made = [(f"c{i % 2}", int(p), int(p + rng.integers(1, length + 1)), f"n{i}") for i, p in enumerate(place)]
    a, b = (spark.createDataFrame(rows, "chrom string, start bigint, end bigint, name string") for rows in (made, made[::-1]))
    found = intervals.interval_overlap(a, b, width=1000)
    want = {(x[3], y[3], max(x[1], y[1]), min(x[2], y[2])) for x in made for y in made if x[0] == y[0] and x[1] < y[2] and y[1] < x[2]}
    rows = found.collect()
    assert len(rows) == len(want) and {(r["a_name"], r["b_name"], r["start"], r["end"]) for r in rows} == want
    found.write.format("noop").mode("overwrite").save()
    joined = intervals.meeting(a, b, width=1000).count()
    assert joined <= 2 * len(want) + len(made)


def test_very_many_equal_p_values(spark):
    p = np.concatenate([np.ones(1500), np.random.default_rng(1).random(1500)])
    frame = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "k bigint, pval double")
    got = {r["k"]: r["fdr"] for r in pvalues.bh_fdr(frame).collect()}
    order = np.argsort(p, kind="stable")
    steps = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    assert np.allclose([got[i] for i in order], np.minimum(1, steps))
    points = sorted((tuple(r) for r in pvalues.qq_points(frame).collect()), key=lambda r: r[0])
    assert [r[0] for r in points] == list(range(1, 3001)) and points[-1][1] == 0 and points[-1][2] == 0


def test_a_cube_grows_by_new_batches_of_new_cells(spark, tmp_path):
    counts_ = spark.createDataFrame([(c, f"g{g}", 1 + (c * g) % 4) for c in range(12) for g in range(3)], "cell_id bigint, gene_id string, x bigint")
    cells_ = spark.createDataFrame([(c, "a" if c % 3 else "b") for c in range(12)], "cell_id bigint, d string")
    path = f"file://{tmp_path}/cube"
    part = lambda low, high, gene: counts_.filter((F.col("cell_id") >= low) & (F.col("cell_id") < high) & F.col("gene_id").isin(gene))
    cube.grow(path, {"one": part(0, 5, ["g0"]), "two": part(0, 5, ["g1", "g2"])}, cells_, ["d"])
    with pytest.raises(ValueError, match="before"):
        cube.grow(path, {"two": part(5, 12, ["g0"])}, cells_, ["d"])
    with pytest.raises(ValueError, match="already"):
        cube.grow(path, {"three": part(4, 6, ["g0"])}, cells_, ["d"])
    cube.grow(path, {"four": part(5, 12, ["g0", "g1", "g2"])}, cells_, ["d"])  # what "three" has left behind does not count
    got, want = ({(r["d"], r["gene_id"]): r for r in f.collect()} for f in (cube.read_cube(spark, path, ["d"]), estimators.estimator_cube(counts_, cells_, ["d"])))
    assert set(got) == set(want)
    for k, r in want.items():
        assert all(got[k][c] == pytest.approx(r[c]) for c in ("nnz", "n_obs", "min", "max", "sum", "mean", "sem"))
