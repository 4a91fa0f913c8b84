"""What the reviewer of round 4 found."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from countstats.operators import groups, pvalues, tables, testing
from countstats.plans import analysis
from countstats.plans.queries import QUERIES


def test_all_pairs_of_parts_and_suppliers_are_listed_however_many(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(tables, "MOST_PAIRS", 44)
    monkeypatch.setattr(tables, "PAIRS_OF_TASK", 100, raising=False)
    parts, suppliers = ({r[0] for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(c).collect()} for t, c in (("part", "p_partkey"), ("supplier", "s_suppkey")))
    found = QUERIES["j3_product_pairs"](spark, sf_dir)
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) == len(parts) * len(suppliers) - len(parts & suppliers)
    assert all(x in parts and y in suppliers and x != y for x, y in rows)
    assert found.rdd.getNumPartitions() >= len(parts) * len(suppliers) // 100


def test_features_too_rare_for_size_factors_give_no_rows(spark):
    """A hundred features, each in one cell of a hundred: none is common enough to take size factors from."""
    cells = spark.range(100).select(F.col("id").alias("cell_id"), (F.col("id") % 2).cast("int").alias("stim"), F.lit(0.07).alias("q"))
    counts = cells.select("cell_id", F.concat(F.lit("g"), "cell_id").alias("gene_id"), F.lit(2).cast("long").alias("x"))
    a = analysis.analyse(counts, cells, ["stim"], min_share=0.9, trim_percent=0.5)
    assert a.cells.filter("size_factor is null").count() == 100
    assert a.moments.count() == 0
    assert testing.draws_of(a.parameters, groups.with_weights(a.compressed, 4), 4).count() == 0


def test_many_p_values_are_combined(spark):
    """Against the same sum in decimals: for one, two, 200 and 5,000 p-values."""
    sizes = {"a": 1, "b": 2, "c": 200, "d": 5000}
    rows = [(g, (i * 7919 % 10007 + 0.5) / 10007) for g, n in sizes.items() for i in range(1, n + 1)]
    found = {r["g"]: r for r in pvalues.fisher_combine(spark.createDataFrame(rows, "g string, pval double"), "pval", ["g"]).collect()}
    with localcontext() as context:
        context.prec = 60
        for g, n in sizes.items():
            half, term, total = Decimal(found[g]["chi2"]) / 2, Decimal(1), Decimal(1)
            for i in range(1, n):
                term = term * half / i
                total += term
            assert found[g]["k"] == n and found[g]["pval"] == pytest.approx(float(total * (-half).exp()), rel=1e-9), g


def test_joint_counts_are_counted_before_they_are_shuffled(spark, monkeypatch):
    """For few listed pairs no join moves what is made of a cell; all ways to count give the same rows."""
    rows = [(c, f"g{g}", 1 + (c * g) % 3) for c in range(90) for g in range(8) if (c * 7 + g * 5) % 3]
    counts = spark.createDataFrame(rows, "cell_id bigint, gene_id string, x bigint")
    cells = spark.createDataFrame([(c, "u" if c % 2 else "v", 1.0 + c % 4) for c in range(90)], "cell_id bigint, grp string, sf_bin double")
    pairs = spark.createDataFrame([(f"g{i}", f"g{j}") for i in range(8) for j in range(i, 8)], "gene_1 string, gene_2 string")
    monkeypatch.setattr(groups, "BIN_ROWS", 20, raising=False)
    found = groups.joint_counts(counts, cells, pairs)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    listed = lambda f: sorted(tuple(r) for r in f.select("grp", "gene_1", "gene_2", "sf_bin", "x1", "x2", "n").collect())
    own = Counter(("u" if c % 2 else "v", a, b, 1.0 + c % 4, x, y) for c, a, x in rows for d, b, y in rows if c == d and a <= b)
    assert listed(found) == sorted((*k, n) for k, n in own.items())
    monkeypatch.setattr(groups, "LISTED", 0, raising=False)
    assert listed(groups.joint_counts(counts, cells, pairs)) == listed(found)
    monkeypatch.setattr(groups, "LISTED", 1000, raising=False)
    few = pairs.filter("gene_1 = 'g0' and gene_2 = 'g1'")
    assert listed(groups.joint_counts(counts, cells, few)) == [r for r in listed(found) if r[1:3] == ("g0", "g1")]
