"""The tables that the registered queries work on, as DataFrames and as SQL common table expressions.

An observation is a customer, a feature a part brand, and the count x the customer's purchases of
that brand in units of ten; market segments and regions are the labels.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counts(spark: SparkSession, d: str, feature: str = "p_brand") -> DataFrame:
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy(F.col("o_custkey").alias("cell_id"), F.expr(feature).cast("string").alias("gene_id")).agg(F.sum(F.ceil(F.col("l_quantity") / 10)).cast("long").alias("x"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("c_custkey").alias("cell_id"), F.col("c_mktsegment").alias("seg"), F.col("n_regionkey").alias("region"), F.col("c_nationkey").alias("nation"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("stim"), F.lit(0.07).alias("q"))


def tests(spark: SparkSession, d: str) -> DataFrame:
    """A p-value for each part by plain arithmetic, in families by brand."""
    key = F.col("p_partkey")
    return table(spark, d, "part").select(key.alias("key"), F.col("p_brand").alias("family"), ((key * 7919 % 10007 + 0.5) / 10007).alias("pval"))


def results(spark: SparkSession, d: str) -> DataFrame:
    """Three methods' p-values and effects of each part."""
    key = F.col("p_partkey")
    rows = table(spark, d, "part").select(key.alias("gene_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("m"))
    return rows.select("gene_id", F.concat(F.lit("m"), F.col("m")).alias("method"), ((F.col("gene_id") * (7919 + 2 * F.col("m")) % 10007 + 0.5) / 10007).alias("pval"), ((F.col("gene_id") * 31 * F.col("m")) % 201 - 100).cast("double").alias("coef"))


def points(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, d, "part").select(F.concat(F.lit("c"), key % 6).alias("chrom"), key.alias("start"), (key + 1).alias("end"), key.cast("string").alias("name"))


def intervals(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey")
    start = key * 37 % 2000
    return table(spark, d, "supplier").select(F.concat(F.lit("c"), key % 6).alias("chrom"), start.alias("start"), (start + 5 + key % 20).alias("end"), key.cast("string").alias("name"))


def genotypes(spark: SparkSession, d: str) -> DataFrame:
    """(individual, snp, dosage): a nation is an individual, and its dose of one of 20 places follows from
    the number of its customers there."""
    nations = table(spark, d, "customer").select(F.col("c_nationkey").alias("n")).distinct()
    places = nations.select("n", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k"))
    seen = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n"), (F.col("c_custkey") % 20).cast("int").alias("k")).agg(F.count("*").alias("c"))
    dose = ((F.coalesce("c", F.lit(0)) + F.col("n") * F.col("k")) % 3).cast("double")
    return places.join(seen, ["n", "k"], "left").select(F.col("n").cast("string").alias("individual"), F.concat(F.lit("s"), F.col("k")).alias("snp"), dose.alias("dosage"))


def covariates(spark: SparkSession, d: str) -> DataFrame:
    """(individual, name, value): the mean balance, in thousands, of each nation's customers."""
    means = table(spark, d, "customer").groupBy("c_nationkey").agg(F.avg(F.col("c_acctbal") / 1000).alias("value"))
    return means.select(F.col("c_nationkey").cast("string").alias("individual"), F.lit("balance").alias("name"), "value")


CTE = {
    "genotypes": "SELECT CAST(n AS VARCHAR) AS individual, 's' || k AS snp, ((coalesce(c, 0) + n * k) % 3)::DOUBLE AS dosage FROM (SELECT DISTINCT c_nationkey AS n FROM customer) CROSS JOIN (SELECT unnest(range(20)) AS k) LEFT JOIN (SELECT c_nationkey AS n, c_custkey % 20 AS k, count(*) AS c FROM customer GROUP BY ALL) USING (n, k)",
    "covariates": "SELECT CAST(c_nationkey AS VARCHAR) AS individual, avg(c_acctbal / 1000) AS value FROM customer GROUP BY 1",
    "counts": "SELECT o_custkey AS cell_id, p_brand AS gene_id, CAST(sum(ceil(l_quantity / 10)) AS BIGINT) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL",
    "cells": "SELECT c_custkey AS cell_id, c_mktsegment AS seg, n_regionkey AS region, c_nationkey AS nation, CAST(c_mktsegment = 'BUILDING' AS INT) AS stim, CAST(0.07 AS DOUBLE) AS q FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "tests": "SELECT p_partkey AS key, p_brand AS family, (p_partkey * 7919 % 10007 + 0.5::DOUBLE) / 10007 AS pval FROM part",
    "results": "SELECT p_partkey AS gene_id, 'm' || m AS method, (p_partkey * (7919 + 2 * m) % 10007 + 0.5::DOUBLE) / 10007 AS pval, ((p_partkey * 31 * m) % 201 - 100)::DOUBLE AS coef FROM part, (SELECT unnest([1, 2, 3]) AS m)",
    "points": "SELECT 'c' || (p_partkey % 6) AS chrom, p_partkey AS \"start\", p_partkey + 1 AS \"end\", CAST(p_partkey AS VARCHAR) AS name FROM part",
    "intervals": "SELECT 'c' || (s_suppkey % 6) AS chrom, s_suppkey * 37 % 2000 AS \"start\", s_suppkey * 37 % 2000 + 5 + s_suppkey % 20 AS \"end\", CAST(s_suppkey AS VARCHAR) AS name FROM supplier",
    "total": "SELECT cells.*, coalesce(t, 0)::DOUBLE AS s FROM cells LEFT JOIN (SELECT cell_id, sum(x) AS t FROM counts GROUP BY 1) USING (cell_id)",
}


def moments_cte(source: str, by: list[str]) -> str:
    keys = "".join(f"{b}, " for b in by)
    using = f"JOIN n USING ({', '.join(by)})" if by else "CROSS JOIN n"
    grouping = f"GROUP BY {', '.join(by)}" if by else ""
    return f"""WITH n AS (SELECT {keys}count(*) AS n_obs, avg(q) AS q, sum(s) AS ss FROM {source} WHERE s > 0 {grouping}),
    t AS (SELECT {keys}gene_id, sum(x / s) AS sx, sum(x / (s * s)) AS sx2, sum(x * x / (s * s)) AS sxx, CAST(sum(x) AS BIGINT) AS total, max(x) AS raw_max, count(*) AS nnz FROM counts JOIN {source} USING (cell_id) WHERE s > 0 GROUP BY {keys}gene_id)
    SELECT *, sx / n_obs AS mean, (sxx - (1 - q) * sx2) / n_obs - (sx / n_obs) * (sx / n_obs) AS var, total / n_obs AS raw_mean FROM t {using}"""


def _det(a: list[list[str]]) -> str:
    minor = lambda i, j, k, m: f"({a[1][i]} * {a[2][j]} - {a[1][k]} * {a[2][m]})"
    return f"({a[0][0]} * {minor(1, 2, 2, 1)} - {a[0][1]} * {minor(0, 2, 2, 0)} + {a[0][2]} * {minor(0, 1, 1, 0)})"


def fit_cte(source: str, by: list[str], condition: str) -> str:
    keys, part = "".join(f"{b}, " for b in by), f"PARTITION BY {', '.join(by)}" if by else ""
    sums = ", ".join([f"sum(pow(z, {k})) AS s{k}" for k in range(5)] + [f"sum(pow(z, {k}) * y) AS t{k}" for k in range(3)])
    normal = [[f"s{i + j}" for j in range(3)] for i in range(3)]
    solved = [_det([[f"t{i}" if j == k else normal[i][j] for j in range(3)] for i in range(3)]) for k in range(3)]
    whole = _det(normal)
    return f"""WITH p AS (SELECT {keys}ln(mean) AS x, ln(var) AS y FROM {source} WHERE mean > 0 AND var > 0 AND {condition}),
    c AS (SELECT *, x - avg(x) OVER ({part}) AS z, avg(x) OVER ({part}) AS center FROM p),
    m AS (SELECT {keys}any_value(center) AS center, {sums} FROM c {f'GROUP BY {", ".join(by)}' if by else ''})
    SELECT {keys}center, {', '.join(f'CASE WHEN abs({whole}) > 1e-12 THEN {c} / {whole} END AS c{k}' for k, c in enumerate(solved))} FROM m"""


_RV = "CASE WHEN mean > 0 AND var > 0 THEN exp(ln(var) - (c0 + c1 * (ln(mean) - center) + c2 * (ln(mean) - center) * (ln(mean) - center))) END"
CTE |= {
    "overall": moments_cte("total", []),
    "overall_fit": fit_cte("overall", [], "raw_mean >= 0.07"),
    "overall_rv": f"SELECT gene_id, {_RV} AS res_var FROM overall, overall_fit WHERE raw_mean >= 0.07",
    "least": "SELECT gene_id, res_var FROM overall_rv WHERE res_var <= (SELECT quantile_cont(res_var, 0.5) FROM overall_rv)",
    "sized": """WITH p AS (SELECT total.* EXCLUDE (s), s AS depth, coalesce(part, 0)::DOUBLE AS part FROM total LEFT JOIN (SELECT cell_id, sum(x) AS part FROM counts SEMI JOIN least USING (gene_id) GROUP BY 1) USING (cell_id) WHERE s > 0)
    SELECT * EXCLUDE (depth, part), (part + (SELECT quantile_cont(part, 0.5) FROM p)) / (SELECT median(part) + quantile_cont(part, 0.5) FROM p) * (SELECT median(depth) FROM p) AS s FROM p""",
    "grouped": "SELECT *, 'sg^' || seg AS grp FROM sized WHERE seg IN (SELECT seg FROM sized GROUP BY 1 HAVING count(*) >= 10)",
    "ends": "SELECT min(s) AS low, max(s) AS high FROM sized",
    "binned": """WITH b AS (SELECT *, CASE WHEN high > low THEN least(floor((s - low) / (high - low) * 30), 29) ELSE 0 END AS bin FROM sized, ends)
    SELECT * EXCLUDE (low, high), 'sg^' || seg AS grp, CASE WHEN s = high THEN s ELSE avg(s) OVER (PARTITION BY bin) END AS sf_bin FROM b""",
    "pairs": "SELECT a.gene_id AS gene_1, b.gene_id AS gene_2 FROM (SELECT DISTINCT gene_id FROM counts) a, (SELECT DISTINCT gene_id FROM counts) b",
}


def analysis_cte(suffix: str, grouped: str, share: float) -> dict[str, str]:
    """Moments, filters, fits, residual variances, covariances and correlations of one grouping."""
    return {
        f"moments{suffix}": moments_cte(grouped, ["grp"]),
        f"kept{suffix}": f"SELECT gene_id, count(*) FILTER (raw_mean > 0.07 AND var > 0) / (SELECT count(DISTINCT grp) FROM {grouped}) AS share FROM moments{suffix} GROUP BY 1 HAVING share > {share}",
        f"mom{suffix}": f"SELECT * FROM moments{suffix} SEMI JOIN kept{suffix} USING (gene_id)",
        f"fit{suffix}": fit_cte(f"mom{suffix}", ["grp"], "raw_max >= 2"),
        f"resid{suffix}": f"SELECT mom{suffix}.*, {_RV} AS res_var FROM mom{suffix} JOIN fit{suffix} USING (grp)",
        f"covs{suffix}": f"""SELECT m1.grp, m1.gene_id AS gene_1, m2.gene_id AS gene_2, m1.n_obs, m1.var AS var_1, m2.var AS var_2,
    coalesce(prod, 0) / m1.n_obs - CASE WHEN m1.gene_id = m2.gene_id THEN (1 - m1.q) * m1.sx2 / m1.n_obs ELSE 0 END - m1.mean * m2.mean AS cov
    FROM pairs JOIN moments{suffix} m1 ON m1.gene_id = gene_1 JOIN moments{suffix} m2 ON m2.gene_id = gene_2 AND m2.grp = m1.grp
    LEFT JOIN (SELECT grp, a.gene_id AS g1, b.gene_id AS g2, sum(a.x / s * b.x / s) AS prod FROM counts a JOIN counts b USING (cell_id) JOIN {grouped} USING (cell_id) WHERE s > 0 GROUP BY ALL) p ON p.grp = m1.grp AND g1 = gene_1 AND g2 = gene_2""",
        f"corrs{suffix}": f"SELECT *, CASE WHEN var_1 > 0 AND var_2 > 0 THEN least(greatest(cov / sqrt(var_1 * var_2), -1), 1) END AS corr FROM covs{suffix}",
    }


CTE |= analysis_cte("", "grouped", 0.7)
CTE["grouped_stim"] = "SELECT *, 'sg^' || stim AS grp FROM sized WHERE stim IN (SELECT stim FROM sized GROUP BY 1 HAVING count(*) >= 10)"
CTE |= analysis_cte("_stim", "grouped_stim", 0.9)
CTE["grouped_sr"] = "SELECT *, 'sg^' || stim || '^' || region AS grp FROM sized WHERE (stim, region) IN (SELECT (stim, region) FROM sized GROUP BY stim, region HAVING count(*) >= 10)"
CTE |= analysis_cte("_sr", "grouped_sr", 0.5)
CTE["grouped_nation"] = "SELECT *, 'sg^' || nation AS grp FROM sized"
CTE |= analysis_cte("_nation", "grouped_nation", 0.3)

#: Two-sided tails by series whose terms are all positive: of a normal z, and of a Student t with df degrees.
NORMAL_P = "greatest(0, 1 - CASE WHEN {z} = 0 THEN 0 ELSE list_sum([exp((0 - {z} * {z} / 2) + (2 * i + 1) * ln(abs({z}) / sqrt(2)) - lgamma(i + 1.5)) FOR i IN range(400)]) END)"
STUDENT_P = "1 - CASE WHEN {t} = 0 THEN 0 ELSE list_sum([exp((i + 0.5) * ln({t} * {t} / ({df} + {t} * {t})) + {df} / 2.0::DOUBLE * ln({df} / ({df} + {t} * {t})) + lgamma((1 + {df}) / 2.0::DOUBLE + i) - lgamma({df} / 2.0::DOUBLE) - lgamma(i + 1.5)) FOR i IN range(2000)]) END"


def sql(select: str) -> str:
    """``select`` behind the common table expressions that it and they name."""
    used: list[str] = []

    def need(text: str) -> None:
        for name in CTE:
            if re.search(rf"\b{name}\b", text) and name not in used and CTE[name] is not text:
                need(CTE[name])
                if name not in used:
                    used.append(name)

    need(select)
    ordered = [n for n in CTE if n in used]
    if ordered and select.startswith("WITH"):
        select = f"SELECT * FROM ({select})"
    return (f"WITH {', '.join(f'{n} AS ({CTE[n]})' for n in ordered)} " if ordered else "") + select
