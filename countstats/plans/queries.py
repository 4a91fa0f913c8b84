"""The registered queries: each applies one operator to the whole tables; SQL beside it where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import argmax_column, average_rank, running_before
from ..functions.lineage import materialize, shared_folder
from ..operators import cube, estimators, groups, intervals, meanvar, prep, pvalues, tables, testing
from ..sources import io
from . import analysis
from . import fixtures as fx
from .fixtures import sql, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(select: str | None = None, feature: str = "p_brand") -> Callable[[Query], Query]:
    """Register a query, and ``select`` behind what it names as its SQL; ``feature`` is what is counted."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if select:
            ORACLES[f.__name__] = sql(select).replace("p_brand AS gene_id", f"{feature} AS gene_id")
        return f

    return register


def r(c, digits: int = 6):
    """Rounded, so that the order of a sum does not show; without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + 0.0


def _total(spark, d):
    return materialize(groups.total_size_factor(fx.counts(spark, d), fx.cells(spark, d)))


def _sized(spark, d):
    return analysis.size_factors(fx.counts(spark, d), fx.cells(spark, d), trim_percent=0.5)


def _analysis(spark, d, labels=("seg",), **options):
    return analysis.analyse(fx.counts(spark, d), fx.cells(spark, d), list(labels), trim_percent=0.5, **options)


def _pairs(spark, d):
    genes = fx.counts(spark, d).select("gene_id").distinct()
    return materialize(tables.product_pairs(genes, genes, exclude_same=False))


# Sources and sinks


@query('SELECT "start" AS "start", "end" AS "end", chrom, name FROM intervals')
def io_bed_round_trip(spark, d):
    path = _scratch(spark, "bed")
    fx.intervals(spark, d).select("chrom", "start", "end", "name").write.option("sep", "\t").csv(path)
    return io.read_bed(spark, path)


@query("SELECT CAST(n_nationkey AS INT) AS n_nationkey, n_name, CAST(n_regionkey AS INT) AS n_regionkey FROM nation")
def io_delimited_round_trip(spark, d):
    path = _scratch(spark, "csv")
    io.write_result(table(spark, d, "nation"), path, "csv")
    return io.read_delimited(spark, path, sep=",", schema="n_nationkey int, n_name string, n_regionkey int")


@query("SELECT CAST(cell_id AS VARCHAR) AS cell_id, gene_id, CAST(x AS DOUBLE) AS x FROM counts")
def io_mtx_round_trip(spark, d):
    counts = materialize(fx.counts(spark, d))
    path = _scratch(spark, "mtx")
    genes = materialize(running_before(counts.select("gene_id").distinct(), [], ["gene_id"], {"g": F.lit(1)}))
    sizes = counts.agg(F.count("*").alias("n"), F.max("cell_id").alias("top")).first()
    head = ["%%MatrixMarket matrix coordinate integer general", "%", f"{genes.count()} {sizes['top'] + 1} {sizes['n']}"]
    spark.createDataFrame([("\n".join(head),)], "value string").write.text(f"{path}/m")
    entries = counts.join(genes, "gene_id").select(F.concat_ws(" ", F.col("g") + 1, F.col("cell_id") + 1, "x").alias("value"))
    entries.write.mode("append").text(f"{path}/m")
    genes.repartitionByRange("g").sortWithinPartitions("g").select(F.col("gene_id").alias("value")).write.text(f"{path}/g")
    spark.range(0, sizes["top"] + 1).select(F.col("id").cast("string").alias("value")).write.text(f"{path}/c")
    return io.read_mtx(spark, f"{path}/m", f"{path}/g", f"{path}/c")


@query("SELECT r AS region, seg, n AS x FROM (SELECT region AS r, seg, count(*) AS n FROM cells GROUP BY ALL)")
def io_wide_to_long(spark, d):
    wide = fx.cells(spark, d).groupBy("region").pivot("seg").count().fillna(0)
    return io.wide_to_long(wide, ["region"], "seg", "x")


@query("SELECT gene_id, cell_id, x FROM counts WHERE x > 20")
def io_write_partitioned(spark, d):
    path = _scratch(spark, "parquet")
    io.write_result(fx.counts(spark, d), path, "parquet", ["gene_id"])
    return spark.read.schema("cell_id bigint, x bigint, gene_id string").parquet(path).filter("x > 20")


def _scratch(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Preparation


@query("SELECT cell_id, gene_id, x FROM counts SEMI JOIN (SELECT cell_id FROM cells WHERE region = 1 AND seg <> 'BUILDING') USING (cell_id)")
def f1_filter_cells(spark, d):
    return prep.filter_cells(fx.counts(spark, d), fx.cells(spark, d), (F.col("region") == 1) & (F.col("seg") != "BUILDING"))[0].select("cell_id", "gene_id", "x")


@query("SELECT gene_id, count(*) AS n FROM counts WHERE gene_id IN (SELECT DISTINCT p_brand FROM part WHERE p_type = 'PROMO') AND gene_id > 'Brand#15' GROUP BY 1")
def f1_filter_genes(spark, d):
    genes = table(spark, d, "part").filter("p_type = 'PROMO'").select(F.col("p_brand").alias("gene_id")).distinct()
    return prep.filter_genes(fx.counts(spark, d), genes, F.col("gene_id") > "Brand#15")[0].groupBy("gene_id").agg(F.count("*").alias("n"))


@query("SELECT cell_id, CAST(coalesce(sum(x), 0) AS BIGINT) AS total, count(x) AS n_genes, round(100.0 * coalesce(sum(x) FILTER (gene_id LIKE 'Brand#2%'), 0) / nullif(sum(x), 0), 6) AS pct_flagged FROM cells LEFT JOIN counts USING (cell_id) GROUP BY 1")
def f2_cell_qc(spark, d):
    return prep.cell_qc(fx.counts(spark, d), fx.cells(spark, d), F.col("gene_id").startswith("Brand#2")).withColumn("pct_flagged", r("pct_flagged"))


@query("SELECT cell_id, gene_id, x FROM counts SEMI JOIN (SELECT cell_id FROM counts GROUP BY 1 HAVING count(*) >= 15) USING (cell_id)")
def f3_min_genes_per_cell(spark, d):
    return prep.min_genes_per_cell(fx.counts(spark, d), 15).select("cell_id", "gene_id", "x")


@query("SELECT cell_id, gene_id, x FROM counts SEMI JOIN (SELECT gene_id FROM counts GROUP BY 1 HAVING count(*) >= (SELECT count(*) // 2 FROM cells)) USING (gene_id)")
def f3_min_cells_per_gene(spark, d):
    return prep.min_cells_per_gene(fx.counts(spark, d), fx.cells(spark, d).count() // 2).select("cell_id", "gene_id", "x")


@query("SELECT gene_id, count(*) AS n FROM counts WHERE NOT starts_with(gene_id, 'Brand#1') AND NOT contains(gene_id, '3') GROUP BY 1")
def f4_drop_genes(spark, d):
    return prep.drop_gene_containing(prep.drop_gene_prefix(fx.counts(spark, d), "Brand#1"), "3").groupBy("gene_id").agg(F.count("*").alias("n"))


@query("SELECT cell_id, gene_id, round(x * 100.0 / sum(x) OVER (PARTITION BY cell_id), 6) AS x FROM counts")
def f5_normalize_total(spark, d):
    return prep.normalize_total(fx.counts(spark, d), 100.0).select("cell_id", "gene_id", r("x").alias("x"))


@query("SELECT cell_id, gene_id, round(3 * x::DOUBLE, 6) AS x FROM counts")
def f6_log_and_back(spark, d):
    logged = prep.log1p(fx.counts(spark, d))
    return prep.undo_log_normalize(logged, F.lit(3.0)).select("cell_id", "gene_id", r("x").alias("x"))


@query("SELECT region, CASE region WHEN 0 THEN 0.05 WHEN 1 THEN 0.06 WHEN 2 THEN 0.07 END::DOUBLE AS q, count(*) AS n FROM cells GROUP BY 1")
def f7_capture_rate(spark, d):
    return prep.assign_capture_rate(fx.cells(spark, d), {0: 0.05, 1: 0.06, 2: 0.07}, "region").groupBy("region", "q").agg(F.count("*").alias("n"))


@query("SELECT CASE seg WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' ELSE 'other' END AS seg, CASE WHEN region = 0 THEN 'zero' WHEN seg LIKE 'A%' THEN 'a' ELSE 'rest' END AS class, count(*) AS n FROM cells GROUP BY ALL")
def f8_relabel(spark, d):
    classed = prep.assign_class(fx.cells(spark, d), [(F.col("region") == 0, "zero"), (F.col("seg").like("A%"), "a")], "rest")
    return prep.relabel(classed, "seg", {"BUILDING": "b", "MACHINERY": "m"}, "other").groupBy("seg", "class").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, split_part(p_brand, '#', 2) AS number, p_brand || '|' || p_type AS label FROM part")
def f9_labels(spark, d):
    return table(spark, d, "part").select("p_partkey", prep.split_label("p_brand", "#", 1).alias("number"), prep.join_label(["p_brand", "p_type"], "|").alias("label"))


@query('SELECT name, chrom, "end" - 1 AS "start", "end" FROM points')
def f10_parse_locus(spark, d):
    loci = fx.points(spark, d).select("name", F.concat_ws(":", "chrom", "end").alias("locus"))
    return prep.parse_locus(loci, "locus").select("name", "chrom", "start", "end")


_TOP = "WITH p AS (SELECT cell_id, gene_id AS tag, x AS n, row_number() OVER (PARTITION BY cell_id ORDER BY x DESC, gene_id) AS k FROM counts), b AS (SELECT cell_id, max(tag) FILTER (k = 1) AS tag, max(n) FILTER (k = 1) AS n, coalesce(max(n) FILTER (k = 2), 0) AS second FROM p GROUP BY 1) SELECT cell_id, tag, n, second, round(second / n, 6) AS ratio FROM b WHERE n > 5 AND second / n < 0.8"


@query(f"SELECT * FROM ({_TOP})")
def f11_top_label(spark, d):
    tags = fx.counts(spark, d).select("cell_id", F.col("gene_id").alias("tag"), F.col("x").alias("n"))
    return prep.top_label_per_cell(tags, 5, 0.8).withColumn("ratio", r("ratio"))


@query("SELECT cell_id, gene_id, round(ln(1 + x / exp(sum(ln(1 + x)) OVER (PARTITION BY cell_id) / 25)), 6) AS x FROM counts")
def f12_clr(spark, d):
    return prep.clr_normalize(fx.counts(spark, d), 25).select("cell_id", "gene_id", r("x").alias("x"))


@query("SELECT seg, string_agg(DISTINCT region::VARCHAR, ',' ORDER BY region::VARCHAR) AS regions, bool_or(region = 3) AS has_three FROM cells GROUP BY 1")
def f13_lists(spark, d):
    distinct = fx.cells(spark, d).select("seg", F.col("region").cast("string").alias("region")).distinct()
    listed = prep.regroup_list(distinct, ["seg"], "region", ",", "all")
    again = prep.explode_list(listed, "all", ",", "region")
    return again.groupBy("seg").agg(F.array_sort(F.collect_list("region")).alias("l")).select("seg", F.array_join("l", ",").alias("regions"), F.array_contains("l", "3").alias("has_three"))


@query("SELECT method, gene_id, round(CASE WHEN coef = 0 THEN -1 ELSE 1 / coef END, 6) AS v FROM results WHERE coef <> 1")
def f14_valid_rows(spark, d):
    rows = fx.results(spark, d).withColumn("v", F.when(F.col("coef") == 1, float("nan")).when(F.col("coef") == 0, float("inf")).otherwise(1 / F.when(F.col("coef") != 0, F.col("coef"))))
    fixed = prep.replace_inf(rows, -1.0, ["v"])
    return prep.valid_rows(prep.fill_missing(fixed.filter("coef <> 1"), 0.0, ["v"]), ["v"]).select("method", "gene_id", r("v").alias("v"))


@query("SELECT seg, region, min(cell_id) AS cell_id FROM cells GROUP BY 1, 2")
def f15_dedupe(spark, d):
    return prep.dedupe(fx.cells(spark, d), ["seg", "region"], [F.col("cell_id")]).select("seg", "region", "cell_id")


@query("SELECT seg, cell_id FROM (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY (xor((cell_id % 2147483647 * 1327217885 + 12378) % 2147483647, ((cell_id % 2147483647 * 1327217885 + 12378) % 2147483647) >> 15) * 48277) % 2147483647, cell_id) AS k FROM cells) WHERE k <= 20")
def f16_stratified_sample(spark, d):
    return prep.stratified_sample(fx.cells(spark, d), ["seg"], 20, "cell_id", seed=3).select("seg", "cell_id")


@query("WITH a AS (SELECT seg, cell_id, row_number() OVER (PARTITION BY seg ORDER BY cell_id) AS k FROM cells), b AS (SELECT seg, region, row_number() OVER (PARTITION BY seg ORDER BY (xor((cell_id % 2147483647 * 1327217885 + 12367) % 2147483647, ((cell_id % 2147483647 * 1327217885 + 12367) % 2147483647) >> 15) * 48275) % 2147483647, cell_id) AS k FROM cells) SELECT seg, cell_id, region FROM a JOIN b USING (seg, k)")
def f17_permute_within(spark, d):
    return prep.permute_within(fx.cells(spark, d), ["seg"], "region", "cell_id", seed=2).select("seg", "cell_id", "region")


# Size factors, groups, bins


@query("SELECT cell_id, s AS size_factor FROM total")
def s1_total_size_factor(spark, d):
    return groups.total_size_factor(fx.counts(spark, d), fx.cells(spark, d)).select("cell_id", "size_factor")


@query("SELECT gene_id, n_obs, round(mean, 8) AS mean, round(var, 8) AS var, round(raw_mean, 6) AS raw_mean FROM overall")
def s2_overall_moments(spark, d):
    return estimators.moments(fx.counts(spark, d), _total(spark, d), []).select("gene_id", "n_obs", r("mean", 8).alias("mean"), r("var", 8).alias("var"), r("raw_mean").alias("raw_mean"))


@query("SELECT gene_id, round(res_var, 6) AS res_var FROM least")
def s3_least_variable_genes(spark, d):
    one = materialize(estimators.moments(fx.counts(spark, d), _total(spark, d), []))
    return meanvar.least_variable_genes(one, 0.5).withColumn("res_var", r("res_var"))


@query("SELECT cell_id, round(s, 6) AS size_factor FROM sized")
def s4_trimmed_size_factor(spark, d):
    return _sized(spark, d).select("cell_id", r("size_factor").alias("size_factor"))


@query("SELECT 'sg^' || seg || '^' || region AS grp, seg, region, count(*) AS n_cells, round(avg(q), 6) AS q FROM cells GROUP BY ALL HAVING count(*) >= 10")
def s5_create_groups(spark, d):
    return groups.create_groups(fx.cells(spark, d), ["seg", "region"])[1].withColumn("q", r("q"))


_COLLIDING = "SELECT cell_id, CASE cell_id % 4 WHEN 0 THEN 'a^b' WHEN 1 THEN 'a' WHEN 2 THEN NULL ELSE '' END AS one, CASE cell_id % 4 WHEN 0 THEN 'c' WHEN 1 THEN 'b^c' ELSE 'z%' END AS two FROM cells"


@query(f"SELECT one, two, count(*) AS n_cells, 'sg^' || coalesce(replace(one, '^', '%d'), '%n') || '^' || replace(replace(two, '%', '%p'), '^', '%d') AS grp, one AS back_one, two AS back_two FROM ({_COLLIDING}) GROUP BY ALL HAVING count(*) >= 10")
def s5_colliding_labels(spark, d):
    """Labels with delimiters, percent signs and nulls never share a group, and come back out of its name."""
    k = F.col("cell_id") % 4
    cells = fx.cells(spark, d).withColumns({"one": F.when(k == 0, "a^b").when(k == 1, "a").when(k == 3, ""), "two": F.when(k == 0, "c").when(k == 1, "b^c").otherwise("z%")})
    found = groups.create_groups(cells, ["one", "two"])[1].select("grp", "one", "two", "n_cells")
    back = groups.split_group_names(found, ["one", "two"]).withColumnsRenamed({"one": "back_one", "two": "back_two"})
    return found.join(back, "grp")


@query("SELECT 'sg^' || seg || '^' || region AS grp, seg, region::DOUBLE AS region FROM cells GROUP BY ALL HAVING count(*) >= 10")
def s6_split_group_names(spark, d):
    return groups.split_group_names(groups.create_groups(fx.cells(spark, d), ["seg", "region"])[1].select("grp"), ["seg", "region"])


@query("SELECT cell_id, round(sf_bin, 6) AS sf_bin FROM binned")
def s7_bin_size_factor(spark, d):
    return groups.bin_size_factor(_sized(spark, d)).select("cell_id", r("sf_bin").alias("sf_bin"))


@query("SELECT grp, gene_id, round(sf_bin, 4) AS sf_bin, x, count(*) AS n FROM counts JOIN binned USING (cell_id) GROUP BY grp, gene_id, round(sf_bin, 4), x")
def s8_compress_counted(spark, d):
    a = _compressible(spark, d)
    return groups.compress(*a).filter("x <> 0").groupBy("grp", "gene_id", r("sf_bin", 4).alias("sf_bin"), "x").agg(F.sum("n").alias("n"))


@query("SELECT g.grp, g.gene_id, c.n - count(counts.cell_id) AS zeros FROM (SELECT DISTINCT grp, gene_id FROM counts JOIN binned USING (cell_id)) g JOIN (SELECT grp, count(*) AS n FROM binned GROUP BY 1) c ON c.grp = g.grp LEFT JOIN binned b ON b.grp = g.grp LEFT JOIN counts ON counts.cell_id = b.cell_id AND counts.gene_id = g.gene_id GROUP BY g.grp, g.gene_id, c.n HAVING c.n > count(counts.cell_id)")
def s8_compress_zeros(spark, d):
    return groups.compress(*_compressible(spark, d)).filter("x = 0").groupBy("grp", "gene_id").agg(F.sum("n").alias("zeros"))


def _compressible(spark, d):
    counts = materialize(fx.counts(spark, d))
    cells = materialize(groups.create_groups(groups.bin_size_factor(analysis.size_factors(counts, fx.cells(spark, d), trim_percent=0.5)), ["seg"])[0])
    return counts, cells, counts.join(cells, "cell_id").select("grp", "gene_id").distinct()


@query("SELECT grp, gene_1, gene_2, coalesce(a.x, 0) AS x1, coalesce(b.x, 0) AS x2, count(*) AS n FROM binned CROSS JOIN pairs LEFT JOIN counts a ON a.cell_id = binned.cell_id AND a.gene_id = gene_1 LEFT JOIN counts b ON b.cell_id = binned.cell_id AND b.gene_id = gene_2 GROUP BY ALL")
def s9_compress_pairs(spark, d):
    counts, cells, _ = _compressible(spark, d)
    return groups.compress_pairs(counts, cells, _pairs(spark, d)).groupBy("grp", "gene_1", "gene_2", "x1", "x2").agg(F.sum("n").alias("n"))


@query("WITH e AS (SELECT quantile_cont(s, [0.25, 0.5, 0.75]) AS e FROM total), k AS (SELECT cell_id, s, len([v FOR v IN e IF v < s]) AS stratum FROM total, e) SELECT cell_id, CAST(stratum AS INT) AS stratum, round(median(s) OVER (PARTITION BY stratum), 6) AS stratum_median FROM k")
def s10_quantile_strata(spark, d):
    return groups.quantile_strata(_total(spark, d), "size_factor", 4, median=True).select("cell_id", "stratum", r("stratum_median").alias("stratum_median"))


@query("SELECT cell_id, CAST(least(floor(s / (SELECT max(s) FROM total) * 5) + 1, 5) AS INT) AS stratum FROM total")
def s11_equal_width_strata(spark, d):
    return groups.equal_width_strata(_total(spark, d), "size_factor", 5).select("cell_id", "stratum")


# Estimators


def _moments(kind, select):
    def run(spark, d):
        counts = materialize(fx.counts(spark, d))
        cells = materialize(groups.create_groups(analysis.size_factors(counts, fx.cells(spark, d), trim_percent=0.5), ["seg"])[0])
        return estimators.moments(counts, cells, ["grp"], kind).select("grp", "gene_id", *[r(c, 8).alias(c) for c in select])

    return run


_E = "SELECT grp, gene_id, round({mean}, 8) AS mean{var} FROM moments"
for _name, _kind, _mean, _var in (
    ("e1_hyper", "hyper_relative", "mean", "var"),
    ("e2_poisson", "poi_relative", "mean", "(sxx - sx2) / n_obs - mean * mean"),
    ("e3_mean_plus_one", "mean_only", "mean + 1", None),
    ("e4_pseudobulk", "pseudobulk", "(total + 1) / (ss + 1)", None),
    ("e6_naive", "naive", "mean", "sxx / n_obs - mean * mean"),
):
    QUERIES[_name] = _moments(_kind, ["mean", "var"] if _var else ["mean"])
    ORACLES[_name] = sql(_E.format(mean=_mean, var=f", round({_var}, 8) AS var" if _var else ""))


_GOOD = "WITH m AS (SELECT grp, x, count(*) AS f FROM counts JOIN grouped USING (cell_id) GROUP BY ALL), w AS (SELECT a.grp, a.x, (a.x + 1) * coalesce(b.f, 0) / a.f AS fixed FROM m a LEFT JOIN m b ON a.grp = b.grp AND b.x = a.x + 1 WHERE a.x < 13) SELECT grp, gene_id, round(sum((CASE WHEN x < 13 THEN fixed ELSE x END) / s) / any_value(n), 8) AS mean FROM counts JOIN grouped USING (cell_id) LEFT JOIN w USING (grp, x) JOIN (SELECT grp, count(*) AS n FROM grouped GROUP BY 1) USING (grp) GROUP BY ALL"


@query(_GOOD)
def e5_good_turing(spark, d):
    counts = materialize(fx.counts(spark, d))
    cells = materialize(groups.create_groups(analysis.size_factors(counts, fx.cells(spark, d), trim_percent=0.5), ["seg"])[0])
    return estimators.good_turing_mean(counts, cells, counts.select("gene_id").distinct(), ["grp"]).withColumn("mean", r("mean", 8))


@query(f"WITH e AS ({_GOOD}) SELECT * FROM e WHERE gene_id IN (SELECT gene_id FROM moments GROUP BY 1 HAVING count(*) FILTER (raw_mean > 0.07) / (SELECT count(DISTINCT grp) FROM grouped) > 0.7)")
def e5_good_mean_analysis(spark, d):
    """The same as the estimator of a whole analysis."""
    return _analysis(spark, d, kind="good_mean_only").moments.select("grp", "gene_id", r("mean", 8).alias("mean"))


@query("SELECT grp, gene_1, gene_2, round(cov, 8) AS cov FROM covs")
def e7_pair_covariance(spark, d):
    counts, cells, _ = _compressible(spark, d)
    return estimators.pair_covariance(counts, cells, _pairs(spark, d)).select("grp", "gene_1", "gene_2", r("cov", 8).alias("cov"))


@query("SELECT grp, gene_1, gene_2, round(cov + CASE WHEN gene_1 = gene_2 THEN (0 - q) * sx2 / moments.n_obs ELSE 0 END, 8) AS cov FROM covs JOIN moments USING (grp) WHERE gene_id = gene_1")
def e8_poisson_covariance(spark, d):
    counts, cells, _ = _compressible(spark, d)
    return estimators.pair_covariance(counts, cells, _pairs(spark, d), kind="poi_relative").select("grp", "gene_1", "gene_2", r("cov", 8).alias("cov"))


def _pair_moments(spark, d):
    counts, cells, _ = _compressible(spark, d)
    one = materialize(estimators.moments(counts, cells))
    return estimators.pair_moments(counts, cells, _pairs(spark, d), one)


@query("SELECT grp, gene_1, gene_2, round(corr, 6) AS corr FROM corrs")
def e9_correlation(spark, d):
    return _pair_moments(spark, d).select("grp", "gene_1", "gene_2", r("corr").alias("corr"))


@query("SELECT grp, gene_1, gene_2, round(corr(coalesce(a.x, 0) / s, coalesce(b.x, 0) / s), 6) AS corr FROM grouped CROSS JOIN pairs LEFT JOIN counts a ON a.cell_id = grouped.cell_id AND a.gene_id = gene_1 LEFT JOIN counts b ON b.cell_id = grouped.cell_id AND b.gene_id = gene_2 WHERE gene_1 <> gene_2 GROUP BY ALL")
def e6_naive_correlation(spark, d):
    counts, cells, _ = _compressible(spark, d)
    one = materialize(estimators.moments(counts, cells, kind="naive"))
    found = estimators.pair_moments(counts, cells, _pairs(spark, d).filter("gene_1 <> gene_2"), one, kind="naive")
    return found.select("grp", "gene_1", "gene_2", r("corr").alias("corr"))


@query("SELECT grp, gene_id, round(ln(1 + total / n_obs), 8) AS mean FROM moments")
def d1_own_estimator(spark, d):
    import numpy as np

    counts, cells, _ = _compressible(spark, d)
    own = estimators.EstimatorSpec(lambda: (F.log1p(F.col("total") / F.col("n_obs")), F.lit(1.0)), lambda x, w, inverse, n, q: (np.log1p(x @ w / n), np.ones(w.shape[1])))
    return estimators.moments(counts, cells, kind=own).select("grp", "gene_id", r("mean", 8).alias("mean"))


@query("SELECT grp, gene_1, gene_2, round(sum(coalesce(a.x, 0) / s * coalesce(b.x, 0) / s) / count(*), 8) AS cov FROM grouped CROSS JOIN pairs LEFT JOIN counts a ON a.cell_id = grouped.cell_id AND a.gene_id = gene_1 LEFT JOIN counts b ON b.cell_id = grouped.cell_id AND b.gene_id = gene_2 GROUP BY ALL")
def d1_own_covariance(spark, d):
    """A mean product that is not centred, in place of the covariance."""
    counts, cells, _ = _compressible(spark, d)
    own = estimators.EstimatorSpec(estimators.get_estimator("naive").point, cov=lambda: F.col("prod") / F.col("n_obs"))
    return estimators.pair_covariance(counts, cells, _pairs(spark, d), kind=own).select("grp", "gene_1", "gene_2", r("cov", 8).alias("cov"))


@query("WITH c AS (SELECT * FROM covs WHERE gene_1 <= gene_2), v AS (SELECT *, CASE WHEN var_1 > 0 AND var_2 > 0 THEN cov / sqrt(var_1 * var_2) END AS raw FROM c), k AS (SELECT grp, gene_1, gene_2, CASE WHEN abs(raw) < 1.05 THEN round(greatest(-1, (CASE WHEN raw > 1 THEN 1 ELSE raw END)), 6) END AS corr FROM v) SELECT * FROM k UNION ALL SELECT grp, gene_2, gene_1, corr FROM k WHERE gene_1 <> gene_2")
def e10_correlation_matrix(spark, d):
    counts, cells, _ = _compressible(spark, d)
    one = materialize(estimators.moments(counts, cells))
    genes = counts.select("gene_id").distinct()
    return estimators.correlation_matrix(counts, cells, one, genes).withColumn("corr", r("corr"))


@query("SELECT grp, gene_id, n_obs, round(mean, 8) AS mean, round(var, 8) AS var, round(res_var, 6) AS res_var FROM resid")
def e11_group_moments(spark, d):
    a = _analysis(spark, d)
    return a.moments.select("grp", "gene_id", "n_obs", r("mean", 8).alias("mean"), r("var", 8).alias("var"), r("res_var").alias("res_var"))


@query("SELECT grp, gene_1, gene_2, round(cov, 8) AS cov, round(var_1, 8) AS var_1, round(var_2, 8) AS var_2, round(corr, 6) AS corr FROM corrs")
def e12_pair_moments(spark, d):
    return _pair_moments(spark, d).select("grp", "gene_1", "gene_2", *[r(c, 8).alias(c) for c in ("cov", "var_1", "var_2")], r("corr").alias("corr"))


@query("SELECT seg, region, gene_id, coalesce(sum(x), 0)::DOUBLE AS value FROM cells CROSS JOIN (SELECT DISTINCT gene_id FROM counts) LEFT JOIN counts USING (cell_id, gene_id) GROUP BY ALL")
def e13_pseudobulk_table(spark, d):
    return estimators.pseudobulk_table(materialize(fx.counts(spark, d)), fx.cells(spark, d), ["seg", "region"])


@query("SELECT gene_id, round(mean * n1, 6) AS z_mean, round((var + mean * mean) * n2 - mean * mean * n1 * n1, 4) AS z_var FROM overall, (SELECT avg(s / 0.07::DOUBLE) AS n1, avg(pow(s / 0.07::DOUBLE, 2)) AS n2 FROM total WHERE s > 0) WHERE raw_mean > 0.1")
def e14_latent_moments(spark, d):
    return estimators.latent_moments(fx.counts(spark, d), _total(spark, d), 0.07, 0.1).select("gene_id", r("z_mean").alias("z_mean"), r("z_var", 4).alias("z_var"))


@query('SELECT seg, region, gene_id, count(*) AS nnz, n_obs, min(x) AS "min", max(x) AS "max", CAST(sum(x) AS BIGINT) AS "sum", round(sum(x / s) / n_obs, 8) AS mean, round(sqrt(greatest(sum(x / s * x / s) / n_obs - pow(sum(x / s) / n_obs, 2), 0) / n_obs), 8) AS sem FROM counts JOIN total USING (cell_id) JOIN (SELECT seg, region, count(*) AS n_obs FROM total WHERE s > 0 GROUP BY ALL) USING (seg, region) GROUP BY seg, region, gene_id, n_obs')
def e15_estimator_cube(spark, d):
    return _cube(spark, d, ["seg", "region"]).withColumn("mean", r("mean", 8)).withColumn("sem", r("sem", 8))


@query('SELECT seg, region, gene_id, count(*) AS nnz, n_obs, min(x) AS "min", max(x) AS "max", CAST(sum(x) AS BIGINT) AS "sum", round(sum(x / s) / n_obs, 8) AS mean, round(sqrt(greatest(sum(x / s * x / s) / n_obs - pow(sum(x / s) / n_obs, 2), 0) / n_obs), 8) AS sem FROM counts JOIN total USING (cell_id) JOIN (SELECT seg, region, count(*) AS n_obs FROM total WHERE s > 0 GROUP BY ALL) USING (seg, region) GROUP BY seg, region, gene_id, n_obs')
def e15_grown_cube(spark, d):
    """Two calls of two batches each: halves of the customers, whose brands come apart."""
    path, cells, dims = f"{shared_folder(spark)}/cube-{uuid.uuid4().hex}", fx.cells(spark, d), ["seg", "region"]
    counts = materialize(fx.counts(spark, d))
    for half in (0, 1):
        own = counts.filter(F.col("cell_id") % 2 == half)
        odd = F.substring("gene_id", 7, 2).cast("int") % 2
        cube.grow(path, {f"{half}-{i}": own.filter(odd == i) for i in (0, 1)}, cells, dims)
    return cube.read_cube(spark, path, dims).withColumn("mean", r("mean", 8)).withColumn("sem", r("sem", 8))


def _cube(spark, d, dims):
    return materialize(estimators.estimator_cube(materialize(fx.counts(spark, d)), fx.cells(spark, d), dims))


@query("SELECT seg, region, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM cells GROUP BY ALL")
def e16_group_counts(spark, d):
    return estimators.group_counts(fx.cells(spark, d), ["seg", "region"]).withColumn("share", r("share"))


@query("WITH m AS (SELECT seg, coalesce(sum(x) FILTER (gene_id = 'Brand#11'), 0) / count(DISTINCT cell_id) AS a, coalesce(sum(x) FILTER (gene_id = 'Brand#22'), 0) / count(DISTINCT cell_id) AS b FROM cells LEFT JOIN counts USING (cell_id) GROUP BY 1) SELECT seg, round(a / max(a) OVER (), 6) AS b11, round(b / max(b) OVER (), 6) AS b22 FROM m")
def e17_marker_matrix(spark, d):
    found = estimators.marker_matrix(materialize(fx.counts(spark, d)), fx.cells(spark, d), ["Brand#11", "Brand#22"], "seg")
    return found.select("seg", r(F.col("`Brand#11`")).alias("b11"), r(F.col("`Brand#22`")).alias("b22"))


# Mean-variance modelling


@query("SELECT gene_id, round(share, 6) AS share FROM kept")
def m1_gene_filters(spark, d):
    counts, cells, _ = _compressible(spark, d)
    one = materialize(estimators.moments(counts, cells))
    return meanvar.gene_filters(one, cells.select("grp").distinct()).withColumn("share", r("share"))


@query("SELECT grp, round(center, 6) AS center, round(c0, 5) AS c0, round(c1, 5) AS c1, round(c2, 4) AS c2 FROM fit")
def m2_fit_mean_variance(spark, d):
    return _analysis(spark, d).fit.select("grp", r("center").alias("center"), r("c0", 5).alias("c0"), r("c1", 5).alias("c1"), r("c2", 4).alias("c2"))


@query("SELECT grp, gene_id, round(res_var, 5) AS res_var FROM resid WHERE res_var IS NOT NULL")
def m3_residual_variance(spark, d):
    return _analysis(spark, d).moments.filter("res_var is not null").select("grp", "gene_id", r("res_var", 5).alias("res_var"))


_LOGS = "SELECT grp, gene_id, n_obs, CASE WHEN mean > 0 THEN ln(mean) END AS m, CASE WHEN res_var > 0 THEN ln(res_var) END AS v FROM resid"


@query(f"SELECT gene_id, 'ALL' AS key, round(sum(m * n_obs) / sum(n_obs) FILTER (m IS NOT NULL), 6) AS log_mean, round(sum(v * n_obs) / sum(n_obs) FILTER (v IS NOT NULL), 5) AS log_res_var FROM ({_LOGS}) GROUP BY 1")
def m4_moments_1d(spark, d):
    a = _analysis(spark, d)
    return meanvar.moments_1d(a.moments, a.groups, "ALL").select("gene_id", "key", r("log_mean").alias("log_mean"), r("log_res_var", 5).alias("log_res_var"))


@query("SELECT gene_1, gene_2, 'ALL' AS key, round(sum(corr * n_obs) / sum(n_obs), 6) AS corr FROM corrs WHERE corr IS NOT NULL GROUP BY ALL")
def m5_moments_2d(spark, d):
    pairs = materialize(_pair_moments(spark, d))
    return meanvar.moments_2d(pairs, pairs.select("grp").distinct(), "ALL").withColumn("corr", r("corr"))


@query("SELECT key, family, round(avg(pval) OVER w, 6) AS trend, round(0.3 * avg(pval) OVER w + 0.7 * pval, 6) AS shrunk FROM tests WINDOW w AS (PARTITION BY family ORDER BY key ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def m6_rolling_trend(spark, d):
    return meanvar.rolling_trend(fx.tests(spark, d), "key", "pval", 5, ["family"], "key", alpha=0.7).select("key", "family", r("trend").alias("trend"), r("shrunk").alias("shrunk"))


@query('WITH g AS (SELECT unnest(range(0, 51)) * 2.0::DOUBLE AS "at"), w AS (SELECT "at", p_size - "at" AS z, exp(-0.5 * pow((p_size - "at") / 4.0::DOUBLE, 2)) AS w, p_retailprice AS y FROM part JOIN g ON abs(p_size - "at") <= 12), s AS (SELECT "at", sum(w) AS w, sum(w * z) AS wx, sum(w * y) AS wy, sum(w * z * z) AS wxx, sum(w * z * y) AS wxy FROM w GROUP BY 1) SELECT "at", round(CASE WHEN w * wxx - wx * wx > 1e-12 THEN (w * wxy - wx * wy) / (w * wxx - wx * wx) END, 5) AS slope FROM s')
def m7_local_slope(spark, d):
    grid = spark.range(51).select((F.col("id") * 2.0).alias("at"))
    return meanvar.local_slope(table(spark, d, "part"), grid, "p_size", "p_retailprice", 4.0).withColumn("slope", r("slope", 5))


_WIDE = "SELECT a.gene_id, a.coef AS x, b.coef AS y, a.gene_id % 4 AS k FROM results a JOIN results b USING (gene_id) WHERE a.method = 'm1' AND b.method = 'm2'"


@query(f"WITH w AS ({_WIDE}), q AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY x) + (count(*) OVER (PARTITION BY k, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY k ORDER BY y) + (count(*) OVER (PARTITION BY k, y) - 1) / 2.0::DOUBLE AS ry FROM w) SELECT k, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(corr(x, y), 6) AS r, round(corr(rx, ry), 6) AS spearman FROM q GROUP BY 1")
def m8_linregress(spark, d):
    found = meanvar.robust_linregress(_wide_results(spark, d), "x", "y", ["k"])
    return found.select("k", *[r(c).alias(c) for c in ("slope", "intercept", "r", "spearman")])


def _wide_results(spark, d):
    rows = fx.results(spark, d)
    side = lambda m, c: rows.filter(F.col("method") == m).select("gene_id", F.col("coef").alias(c))
    return side("m1", "x").join(side("m2", "y"), "gene_id").withColumn("k", F.col("gene_id") % 4)


@query(f"SELECT k, round(2 * covar_samp(x, y) / (var_samp(x) + var_samp(y) + pow(avg(x) - avg(y), 2)), 6) AS concordance FROM ({_WIDE}) GROUP BY 1")
def m9_concordance(spark, d):
    return meanvar.concordance(_wide_results(spark, d), "x", "y", ["k"]).withColumn("concordance", r("concordance"))


@query("WITH v AS (SELECT c.grp, gene_1, gene_2, cov / nullif(var_1, 0) AS beta, a.mean AS m1, b.mean AS m2 FROM covs c JOIN moments a ON a.grp = c.grp AND a.gene_id = gene_1 JOIN moments b ON b.grp = c.grp AND b.gene_id = gene_2 WHERE c.grp IN ('sg^BUILDING', 'sg^MACHINERY')), t AS (SELECT gene_1, gene_2, max(m2) FILTER (grp = 'sg^MACHINERY') - max(m2) FILTER (grp = 'sg^BUILDING') AS tau, max(m2 - beta * m1) FILTER (grp = 'sg^MACHINERY') - max(m2 - beta * m1) FILTER (grp = 'sg^BUILDING') AS direct FROM v GROUP BY ALL) SELECT gene_1, gene_2, round(tau, 8) AS tau, round(direct, 8) AS tau_direct, round(tau - direct, 8) AS effect FROM t")
def m10_mediation(spark, d):
    counts, cells, _ = _compressible(spark, d)
    one = materialize(estimators.moments(counts, cells))
    pair = materialize(estimators.pair_moments(counts, cells, _pairs(spark, d), one))
    return meanvar.mediation_effect(one, pair, "sg^BUILDING", "sg^MACHINERY").select("gene_1", "gene_2", *[r(c, 8).alias(c) for c in ("tau", "tau_direct", "effect")])


# Bootstrap and tests


def _one_test(spark, d, **options):
    return analysis.binary_test_1d(fx.counts(spark, d), fx.cells(spark, d), "stim", num_boot=1000, trim_percent=0.5, **options)


@query()
def h8_binary_test_1d(spark, d):
    return _one_test(spark, d)


@query("SELECT a.gene_id AS gene, 'stim' AS tx, round(ln(b.mean) - ln(a.mean), 6) + 0.0::DOUBLE AS de_coef, round(ln(b.res_var) - ln(a.res_var), 4) + 0.0::DOUBLE AS dv_coef FROM resid_stim a JOIN resid_stim b USING (gene_id) WHERE a.grp = 'sg^0' AND b.grp = 'sg^1'")
def h8_observed_effects(spark, d):
    """The coefficients of ht_1d before any draw."""
    found = analysis.binary_test_1d(fx.counts(spark, d), fx.cells(spark, d), "stim", num_boot=0, trim_percent=0.5)
    return found.select("gene", "tx", r("de_coef").alias("de_coef"), r("dv_coef", 4).alias("dv_coef"))


@query()
def h10_mean_summary(spark, d):
    a = _analysis(spark, d)
    return testing.mean_summary(a.parameters, a.compressed, 400)


@query("SELECT grp, gene_id, round(mean, 8) AS mean, 0.0::DOUBLE AS sem FROM resid WHERE res_var >= 0 AND mean > 0")
def h10_observed_mean(spark, d):
    a = _analysis(spark, d)
    return testing.mean_summary(a.parameters, a.compressed, 0).select("grp", "gene_id", r("mean", 8).alias("mean"), "sem")


def _given(labels: str, weights: str, genes: str, draws: int) -> str:
    """Compressed rows with given weights (see groups.with_weights) as CTE: b, c and w; ``weights`` names the values."""
    mixed = f"n * 7 + 5 + {weights}"
    return f"""b AS (SELECT cell_id, 'sg^' || {labels} AS grp, sf_bin, q FROM binned), bins AS (SELECT grp, sf_bin, count(*) AS m FROM b GROUP BY ALL),
    qs AS (SELECT grp, avg(q) AS q, count(*) AS cells FROM b GROUP BY 1), {genes},
    w AS (SELECT *, greatest(n + (({mixed}) * (2 * d + 3) + d * d) % 5 - 2, 0)::DOUBLE AS w FROM c, (SELECT unnest(range(1, {draws} + 1)) AS d))"""


def _filled(c: str, source: str, keys: str, valid: str) -> str:
    """f_<c>: the draws of ``source``, invalid ones replaced in turn by the first, second ... valid one."""
    same = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return f"""v_{c} AS (SELECT {keys}, d, {c}, coalesce({valid}, false) AS ok, row_number() OVER (PARTITION BY {keys}, coalesce({valid}, false) ORDER BY d) - 1 AS k, count(*) FILTER ({valid}) OVER (PARTITION BY {keys}) AS valid FROM {source}),
    f_{c} AS (SELECT {', '.join(f'a.{k}' for k in keys.split(', '))}, a.d, CASE WHEN a.ok THEN a.{c} ELSE b.{c} END AS {c} FROM (SELECT * FROM v_{c} WHERE valid > 0) a LEFT JOIN (SELECT * FROM v_{c} WHERE ok) b ON NOT a.ok AND {same} AND b.k = a.k % a.valid)"""


def _given_1d(labels: str, suffix: str, draws: int) -> str:
    """Means and residual variances of given draws, invalid ones replaced in turn by valid ones: CTE up to f."""
    genes = f"""nz AS (SELECT grp, gene_id, sf_bin, x, count(*) AS n FROM counts JOIN b USING (cell_id) SEMI JOIN kept{suffix} USING (gene_id) GROUP BY ALL),
    z AS (SELECT grp, gene_id, sf_bin, 0 AS x, m - coalesce(u, 0) AS n FROM (SELECT grp, gene_id FROM resid{suffix}) JOIN bins USING (grp) LEFT JOIN (SELECT grp, gene_id, sf_bin, sum(n) AS u FROM nz GROUP BY ALL) USING (grp, gene_id, sf_bin)),
    c AS (SELECT grp, gene_id, sf_bin, x, n::BIGINT AS n FROM nz UNION ALL SELECT grp, gene_id, sf_bin, x, n::BIGINT FROM z WHERE n > 0)"""
    return f"""{_given(labels, '2 * x', genes, draws)},
    s AS (SELECT grp, gene_id, d, sum(x / sf_bin * w) / any_value(cells) AS mean, sum((x * x - (1 - q) * x) / (sf_bin * sf_bin) * w) / any_value(cells) - pow(sum(x / sf_bin * w) / any_value(cells), 2) AS var FROM w JOIN qs USING (grp) GROUP BY grp, gene_id, d),
    m AS (SELECT s.grp, s.gene_id, s.d, s.mean, CASE WHEN s.mean > 0 AND s.var > 0 THEN exp(ln(s.var) - (c0 + c1 * (ln(s.mean) - center) + c2 * pow(ln(s.mean) - center, 2))) END AS rv FROM s JOIN fit{suffix} USING (grp) JOIN resid{suffix} o USING (grp, gene_id) WHERE o.mean > 0 AND o.res_var >= 0),
    {_filled('mean', 'm', 'grp, gene_id', 'mean > 0')}, {_filled('rv', 'm', 'grp, gene_id', 'rv > 0')}, f AS (SELECT grp, gene_id, d, ln(mean) AS de, ln(rv) AS dv FROM f_mean JOIN f_rv USING (grp, gene_id, d))"""


def _tail(z: str) -> str:
    """The upper tail of a normal."""
    return f"(CASE WHEN {z} >= 0 THEN {fx.NORMAL_P.format(z=f'({z})')} / 2 ELSE 1 - {fx.NORMAL_P.format(z=f'({z})')} / 2 END)"


def _summary(name: str, observed_only: bool = False, digits: int = 6) -> str:
    """coef, se and p of observed o_<name> and draws d_<name>, of which there are many rows."""
    o, m, sd = f"any_value(o_{name})", f"avg(d_{name})", f"stddev_pop(d_{name})"
    coef = o if observed_only else f"({o} + sum(d_{name})) / (1 + count(d_{name}))"
    p = f"{_tail(f'(abs({o}) - ({m} - {o})) / {sd}')} + {_tail(f'(abs({o}) + ({m} - {o})) / {sd}')}"
    return f"round({coef}, {digits}) + 0.0::DOUBLE AS {name}_coef, round({sd}, {digits}) AS {name}_se, CASE WHEN {sd} > 0 THEN round({p}, {digits - 1}) + 0.0::DOUBLE END AS {name}_pval"


@query(f"WITH {_given_1d('stim', '_stim', 24)}, o AS (SELECT gene_id, grp, ln(mean) AS de, ln(res_var) AS dv FROM resid_stim WHERE mean > 0 AND res_var >= 0), t AS (SELECT a.gene_id, b.de - a.de AS d_de, b.dv - a.dv AS d_dv, p.de - c.de AS o_de, p.dv - c.dv AS o_dv FROM f a JOIN f b ON b.gene_id = a.gene_id AND b.d = a.d AND a.grp = 'sg^0' AND b.grp = 'sg^1' JOIN o c ON c.gene_id = a.gene_id AND c.grp = 'sg^0' JOIN o p ON p.gene_id = a.gene_id AND p.grp = 'sg^1') SELECT gene_id AS gene, 'stim' AS tx, {_summary('de')}, {_summary('dv', digits=5)} FROM t GROUP BY 1")
def h8_given_draws(spark, d):
    """The test of means and variability on given weights, with p-values: H3, H5, H7, H8."""
    a = _analysis(spark, d, ["stim"], min_share=0.9)
    found = testing.ht_1d(a.parameters, groups.with_weights(a.compressed, 24), analysis.design_of(a, ["stim"]), ["stim"], num_boot=24)
    return found.select("gene", "tx", *[r(f"de_{c}", 6 - (c == "pval")).alias(f"de_{c}") for c in ("coef", "se", "pval")], *[r(f"dv_{c}", 5 - (c == "pval")).alias(f"dv_{c}") for c in ("coef", "se", "pval")])


@query(f"WITH {_given_1d('stim', '_stim', 24)} SELECT grp, gene_id, round(avg(mean), 7) AS drawn_mean, round(ln(avg(rv)), 5) AS drawn_rv FROM f_mean JOIN f_rv USING (grp, gene_id, d) GROUP BY ALL", feature="CAST(p_partkey AS VARCHAR)")
def h3_given_draws_of_parts(spark, d):
    """Draws of parts, of which few are sold, so that many are invalid and replaced: H1, H3, H4, by their
    means over draws, the variance's as a logarithm."""
    a = analysis.analyse(fx.counts(spark, d, "p_partkey"), fx.cells(spark, d), ["stim"], min_share=0.9, trim_percent=0.5)
    draw = testing.draws_of(a.parameters, groups.with_weights(a.compressed, 24), 24)
    return draw.select("grp", "gene_id", r("drawn_mean", 7).alias("drawn_mean"), r(F.log("drawn_rv"), 5).alias("drawn_rv"))


@query(
    f"""WITH {_given_1d("stim || '^' || region", '_sr', 24)}, o AS (SELECT gene_id, grp, 0 AS d, ln(mean) AS de, ln(res_var) AS dv FROM resid_sr WHERE mean > 0 AND res_var >= 0),
    y AS (SELECT gene_id, grp, d, de, dv, substr(grp, 4, 1)::DOUBLE AS t, cells::DOUBLE AS w FROM (SELECT gene_id, grp, d, de, dv FROM f UNION ALL SELECT o.* EXCLUDE (d, de, dv), o.d, o.de, o.dv FROM o) JOIN qs USING (grp)),
    e AS (SELECT gene_id, grp, d, w, row_number() OVER (PARTITION BY gene_id, d ORDER BY grp) - 1 AS g, count(*) OVER (PARTITION BY gene_id, d) AS k, t - sum(w * t) OVER p / sum(w) OVER p AS t, de - sum(w * de) OVER p / sum(w) OVER p AS de, dv - sum(w * dv) OVER p / sum(w) OVER p AS dv FROM y WINDOW p AS (PARTITION BY gene_id, d)),
    pick AS (SELECT gene_id, d, (3 * g + 5 * (d - 1) + 1) % k AS pg, (7 * g + 11 * (d - 1) + 3) % 24 + 1 AS pd FROM e WHERE d > 0),
    drawn AS (SELECT pick.gene_id, pick.d, e.w, e.t, e.de, e.dv FROM pick JOIN e ON e.gene_id = pick.gene_id AND e.g = pg AND e.d = pd),
    sums AS (SELECT gene_id, d, sum(w) AS w, sum(w * t) AS wt, sum(w * t * t) AS wtt, sum(w * de) AS we, sum(w * t * de) AS wte, sum(w * dv) AS wv, sum(w * t * dv) AS wtv FROM (SELECT * FROM drawn UNION ALL SELECT gene_id, d, w, t, de, dv FROM e WHERE d = 0) GROUP BY ALL),
    coefs AS (SELECT gene_id, d, CASE WHEN wtt - wt * wt / w > 1e-9 THEN (wte - wt * we / w) / (wtt - wt * wt / w) END AS de, CASE WHEN wtt - wt * wt / w > 1e-9 THEN (wtv - wt * wv / w) / (wtt - wt * wt / w) END AS dv FROM sums),
    t AS (SELECT x.gene_id, x.de AS d_de, x.dv AS d_dv, c.de AS o_de, c.dv AS o_dv FROM coefs x JOIN coefs c ON c.gene_id = x.gene_id AND c.d = 0 WHERE x.d > 0) SELECT gene_id AS gene, 'stim' AS tx, {_summary('de', digits=5)}, {_summary('dv', digits=5)} FROM t GROUP BY 1"""
)
def h6_given_hierarchical(spark, d):
    """The hierarchical bootstrap with given weights and given picks of groups and draws."""
    a = _analysis(spark, d, ["stim", "region"], min_share=0.5)
    found = testing.ht_1d(a.parameters, groups.with_weights(a.compressed, 24), analysis.design_of(a, ["stim"]), ["stim"], num_boot=24, resample_groups=True)
    return found.select("gene", "tx", *[r(f"{s}_{c}", 5 - (c == "pval")).alias(f"{s}_{c}") for s in ("de", "dv") for c in ("coef", "se", "pval")])


_GIVEN_2D = """ks AS (SELECT a.gene_id AS gene_1, b.gene_id AS gene_2 FROM kept_stim a JOIN kept_stim b ON a.gene_id < b.gene_id), cs AS (SELECT cell_id, grp, sf_bin, gene_id, x FROM counts JOIN b USING (cell_id)),
    pv AS (SELECT coalesce(a.cell_id, b.cell_id) AS cell_id, coalesce(a.gene_1, b.gene_1) AS gene_1, coalesce(a.gene_2, b.gene_2) AS gene_2, coalesce(a.grp, b.grp) AS grp, coalesce(a.sf_bin, b.sf_bin) AS sf_bin, coalesce(a.x, 0) AS x1, coalesce(b.x, 0) AS x2 FROM (SELECT * FROM cs JOIN ks ON gene_id = gene_1) a FULL JOIN (SELECT * FROM cs JOIN ks ON gene_id = gene_2) b ON a.cell_id = b.cell_id AND a.gene_1 = b.gene_1 AND a.gene_2 = b.gene_2),
    nz AS (SELECT grp, gene_1, gene_2, sf_bin, x1, x2, count(*) AS n FROM pv GROUP BY ALL), z AS (SELECT grp, gene_1, gene_2, sf_bin, 0 AS x1, 0 AS x2, m - coalesce(u, 0) AS n FROM bins CROSS JOIN ks LEFT JOIN (SELECT grp, gene_1, gene_2, sf_bin, sum(n) AS u FROM nz GROUP BY ALL) USING (grp, gene_1, gene_2, sf_bin)),
    c AS (SELECT grp, gene_1, gene_2, sf_bin, x1, x2, n::BIGINT AS n FROM nz UNION ALL SELECT grp, gene_1, gene_2, sf_bin, x1, x2, n::BIGINT FROM z WHERE n > 0)"""
_V = "sum((x{i} * x{i} - (1 - q) * x{i}) / (sf_bin * sf_bin) * w) / any_value(cells) - pow(sum(x{i} / sf_bin * w) / any_value(cells), 2) AS v{i}"


@query(
    f"WITH {_given('stim', '2 * x1 + 3 * x2', _GIVEN_2D, 12)}, s AS (SELECT grp, gene_1, gene_2, d, {_V.format(i=1)}, {_V.format(i=2)}, sum(x1 * x2 / (sf_bin * sf_bin) * w) / any_value(cells) - sum(x1 / sf_bin * w) / any_value(cells) * (sum(x2 / sf_bin * w) / any_value(cells)) AS cov FROM w JOIN qs USING (grp) GROUP BY grp, gene_1, gene_2, d), m AS (SELECT grp, gene_1, gene_2, d, CASE WHEN v1 > 0 AND v2 > 0 THEN cov / sqrt(v1 * v2) END AS r FROM s), {_filled('r', 'm', 'grp, gene_1, gene_2', 'abs(r) < 1')}, g AS (SELECT f_r.*, corr FROM f_r JOIN (SELECT grp, gene_1, gene_2, corr FROM corrs_stim WHERE abs(corr) < 1) USING (grp, gene_1, gene_2)), t AS (SELECT b.gene_1, b.gene_2, b.r - coalesce(a.r, 0) AS d_corr, b.corr - coalesce(a.corr, 0) AS o_corr FROM g b LEFT JOIN (SELECT * FROM g WHERE grp = 'sg^0') a ON a.gene_1 = b.gene_1 AND a.gene_2 = b.gene_2 AND a.d = b.d WHERE b.grp = 'sg^1') SELECT gene_1, gene_2, 'stim' AS tx, {_summary('corr', True)} FROM ks LEFT JOIN t USING (gene_1, gene_2) GROUP BY gene_1, gene_2"
)
def h9_given_draws(spark, d):
    """The test of correlations on given weights, invalid draws replaced, with p-values: H2, H3, H9. Where only
    the treated group can be tested, it is a test of one sample."""
    a = _analysis(spark, d, ["stim"], min_share=0.9)
    params, compressed = analysis.pair_analysis(a, _pairs(spark, d).filter("gene_1 < gene_2"))
    found = testing.ht_2d(params, groups.with_weights(compressed, 12), analysis.design_of(a, ["stim"]), ["stim"], num_boot=12)
    return found.select("gene_1", "gene_2", "tx", *[r(f"corr_{c}", 6 - (c == "pval")).alias(f"corr_{c}") for c in ("coef", "se", "pval")])


@query()
def h12_ht_mean(spark, d):
    return analysis.mean_test(fx.counts(spark, d), fx.cells(spark, d), "stim", ["region"], num_boot=200, trim_percent=0.5)


_STIM_HALF = "SELECT *, 'sg^' || stim || '^' || (cell_id % 2) AS grp FROM sized"


@query(f"WITH g AS ({_STIM_HALF}), m AS ({fx.moments_cte('g', ['grp'])}), k AS (SELECT gene_id FROM m GROUP BY 1 HAVING count(*) FILTER (raw_mean > 0.07 AND var > 0) / (SELECT count(DISTINCT grp) FROM g) > 0.7), o AS (SELECT * FROM m SEMI JOIN k USING (gene_id)), f AS ({fx.fit_cte('o', ['grp'], 'raw_max >= 2')}), v AS (SELECT o.*, {fx._RV} AS res_var FROM o JOIN f USING (grp)), t AS (SELECT grp, any_value(stim) AS stim, sum(x)::DOUBLE AS total FROM counts JOIN g USING (cell_id) GROUP BY 1) SELECT v.gene_id, 'stim' AS tx, round(ln(sum(v.mean * t.total) FILTER (stim = 1) / sum(t.total) FILTER (stim = 1)) - ln(sum(v.mean * t.total) FILTER (stim = 0) / sum(t.total) FILTER (stim = 0)), 5) + 0.0::DOUBLE AS coef FROM v JOIN t USING (grp) WHERE res_var >= 0 AND v.mean > 0 GROUP BY 1")
def h12_observed_effects(spark, d):
    """The coefficients of the Poisson regressions with the observed means: with one 0/1 treatment the
    logs of two ratios."""
    cells = fx.cells(spark, d).withColumn("half", F.col("cell_id") % 2)
    found = analysis.mean_test(fx.counts(spark, d), cells, "stim", ["half"], num_boot=0, trim_percent=0.5)
    return found.select("gene_id", "tx", r("coef", 5).alias("coef"))


@query()
def h14_binary_test_2d(spark, d):
    return analysis.binary_test_2d(fx.counts(spark, d), fx.cells(spark, d), _pairs(spark, d), "stim", num_boot=300, trim_percent=0.5)


@query("WITH c AS (SELECT * FROM corrs_stim WHERE gene_1 IN (SELECT gene_id FROM kept_stim) AND gene_2 IN (SELECT gene_id FROM kept_stim)) SELECT gene_1, gene_2, 'stim' AS tx, round(max(corr) FILTER (grp = 'sg^1' AND gene_1 <> gene_2 AND abs(corr) < 1) - max(corr) FILTER (grp = 'sg^0' AND gene_1 <> gene_2 AND abs(corr) < 1), 6) + 0.0::DOUBLE AS corr_coef FROM c GROUP BY ALL")
def h14_observed_effects(spark, d):
    found = analysis.binary_test_2d(fx.counts(spark, d), fx.cells(spark, d), _pairs(spark, d), "stim", num_boot=0, trim_percent=0.5)
    return found.select("gene_1", "gene_2", "tx", r("corr_coef").alias("corr_coef"))


def _coexpression_qtl(spark, d, **options):
    """Each pair of genes is tested for the doses of two places of its own, over nations."""
    cells = fx.cells(spark, d)
    a = analysis.analyse(fx.counts(spark, d), cells, ["nation"], min_share=0.3, trim_percent=0.5, min_cell_count=1)
    params, compressed = analysis.pair_analysis(a, _pairs(spark, d).filter("gene_1 < gene_2"))
    doses = analysis.doses_by_group(fx.genotypes(spark, d), a, "nation")
    place = lambda side: F.concat(F.lit("s"), F.substring(side, 7, 2).cast("int") % 20)
    named = params.select("gene_1", "gene_2", F.explode(F.array_distinct(F.array(place("gene_1"), place("gene_2")))).alias("tx")).distinct()
    return testing.ht_2d(params, compressed, analysis.design_of(a, []), tests=named.join(doses, "tx"), resample_groups=True, **options)


@query()
def h14_coexpression_qtl(spark, d):
    return _coexpression_qtl(spark, d, num_boot=100)


@query(
    "WITH c AS (SELECT grp, gene_1, gene_2, corr, n_obs FROM corrs_nation WHERE gene_1 < gene_2 AND gene_1 IN (SELECT gene_id FROM kept_nation) AND gene_2 IN (SELECT gene_id FROM kept_nation)), p AS (SELECT DISTINCT gene_1, gene_2, 's' || (unnest([substr(gene_1, 7, 2)::INT, substr(gene_2, 7, 2)::INT]) % 20) AS tx FROM c), v AS (SELECT p.*, g.dosage AS t, corr AS y, n_obs::DOUBLE AS w FROM p JOIN c USING (gene_1, gene_2) JOIN genotypes g ON g.snp = tx AND 'sg^' || individual = grp WHERE abs(corr) < 1), s AS (SELECT gene_1, gene_2, tx, sum(w) AS w, sum(w * t) AS wt, sum(w * y) AS wy, sum(w * t * t) AS wtt, sum(w * t * y) AS wty FROM v GROUP BY ALL) SELECT p.gene_1, p.gene_2, p.tx, round(CASE WHEN wtt / w - (wt / w) * (wt / w) > 1e-9 THEN (wty - wt * wy / w) / (wtt - wt * wt / w) END, 5) + 0.0::DOUBLE AS corr_coef FROM p LEFT JOIN s USING (gene_1, gene_2, tx)"
)
def h14_observed_coexpression_qtl(spark, d):
    found = _coexpression_qtl(spark, d, num_boot=0)
    return found.select("gene_1", "gene_2", "tx", r("corr_coef", 5).alias("corr_coef"))


def _eqtl(spark, d, num_boot):
    cells = fx.cells(spark, d).withColumn("individual", F.col("nation").cast("string"))
    pairs = fx.counts(spark, d).select("gene_id").distinct().crossJoin(fx.genotypes(spark, d).select("snp").distinct())
    return analysis.run_eqtl(fx.counts(spark, d), cells, fx.genotypes(spark, d), fx.covariates(spark, d), pairs, num_boot=num_boot, trim_percent=0.5, min_cell_count=1, q=0.07)


@query()
def h15_run_eqtl(spark, d):
    return _eqtl(spark, d, 200)


@query(
    "WITH n AS (SELECT grp, gene_id, sx / n_obs + 1 AS mean, total / n_obs AS raw, n_obs FROM moments_nation), k AS (SELECT gene_id FROM n GROUP BY 1 HAVING count(*) FILTER (raw > 0.07) / (SELECT count(DISTINCT grp) FROM grouped_nation) > 0.3), v AS (SELECT gene_id AS gene, snp AS tx, ln(mean) AS y, dosage AS t, value AS c, n_obs::DOUBLE AS w FROM n SEMI JOIN k USING (gene_id) JOIN genotypes ON 'sg^' || genotypes.individual = grp JOIN covariates USING (individual)), s AS (SELECT gene, tx, sum(w) AS w, sum(w * t) / sum(w) AS mt, sum(w * y) / sum(w) AS my, sum(w * c) / sum(w) AS mc FROM v GROUP BY ALL), q AS (SELECT gene, tx, sum(v.w * (t - mt) * (t - mt)) AS tt, sum(v.w * (c - mc) * (c - mc)) AS cc, sum(v.w * (t - mt) * (c - mc)) AS tc, sum(v.w * (y - my) * (t - mt)) AS ty, sum(v.w * (y - my) * (c - mc)) AS cy FROM v JOIN s USING (gene, tx) GROUP BY ALL) SELECT gene, tx, round(CASE WHEN tt > 1e-9 AND tt - tc * tc / cc > 1e-6 * tt THEN (ty - tc * cy / cc) / (tt - tc * tc / cc) END, 6) + 0.0::DOUBLE AS de_coef FROM q"
)
def h15_observed_effects(spark, d):
    return _eqtl(spark, d, 0).select("gene", "tx", r("de_coef").alias("de_coef"))


_CUBE = "SELECT seg, gene_id, sum(x / s) / n_obs AS mean, sqrt(greatest(sum(x / s * x / s) / n_obs - pow(sum(x / s) / n_obs, 2), 0) / n_obs) AS sem FROM counts JOIN total USING (cell_id) JOIN (SELECT seg, count(*) AS n_obs FROM total WHERE s > 0 GROUP BY ALL) USING (seg) GROUP BY seg, gene_id, n_obs"


@query(f"WITH c AS ({_CUBE}), l AS (SELECT *, CASE WHEN mean > sem THEN (ln(mean + sem) - ln(mean - sem)) / 2 END AS se FROM c) SELECT a.gene_id, round(ln(b.mean) - ln(a.mean), 6) AS lfc, round(sqrt(a.se * a.se + b.se * b.se), 6) AS se, round((ln(b.mean) - ln(a.mean)) / nullif(sqrt(a.se * a.se + b.se * b.se), 0), 5) AS z FROM l a JOIN l b USING (gene_id) WHERE a.seg = 'BUILDING' AND b.seg = 'MACHINERY'")
def h16_pairwise_cube(spark, d):
    found = testing.pairwise_cube_effects(_cube(spark, d, ["seg"]), "seg", "BUILDING", "MACHINERY")
    return found.select("gene_id", r("lfc").alias("lfc"), r("se").alias("se"), r("z", 5).alias("z"))


@query(f"WITH c AS ({_CUBE}), l AS (SELECT *, CASE WHEN mean > sem THEN (ln(mean + sem) - ln(mean - sem)) / 2 END AS se FROM c), z AS (SELECT a.gene_id, (ln(b.mean) - ln(a.mean)) / nullif(sqrt(a.se * a.se + b.se * b.se), 0) AS z FROM l a JOIN l b USING (gene_id) WHERE a.seg = 'BUILDING' AND b.seg = 'MACHINERY') SELECT gene_id, CASE WHEN z IS NOT NULL THEN round({fx.NORMAL_P.format(z='z')}, 8) END AS pval FROM z")
def h16_pairwise_cube_test(spark, d):
    return testing.pairwise_cube_test(_cube(spark, d, ["seg"]), "seg", "BUILDING", "MACHINERY").select("gene_id", r("pval", 8).alias("pval"))


@query(
    "WITH c AS (SELECT stim, region, gene_id, n_obs, sum(x / s) / n_obs AS mean, sqrt(greatest(sum(x / s * x / s) / n_obs - pow(sum(x / s) / n_obs, 2), 0) / n_obs) AS sem FROM counts JOIN total USING (cell_id) JOIN (SELECT stim, region, count(*) AS n_obs FROM total WHERE s > 0 GROUP BY ALL) USING (stim, region) GROUP BY stim, region, gene_id, n_obs), b AS (SELECT * FROM c WHERE region IN (SELECT region FROM c GROUP BY 1 HAVING count(DISTINCT stim) > 1)), v AS (SELECT * FROM b WHERE n_obs > 20 AND mean > 0 AND sem > 0), k AS (SELECT gene_id FROM v GROUP BY 1 HAVING count(*) >= 0.7 * (SELECT count(*) FROM (SELECT DISTINCT stim, region FROM b))), p AS (SELECT gene_id, region, max(ln(mean)) FILTER (stim = 1) - max(ln(mean)) FILTER (stim = 0) AS d, sum(pow(sem / mean, 2)) AS s FROM v SEMI JOIN k USING (gene_id) GROUP BY ALL HAVING count(*) = 2) SELECT gene_id, round(avg(d), 6) + 0.0::DOUBLE AS coef, round(sqrt(sum(s)) / count(*), 6) AS se FROM p GROUP BY 1"
)
def h17_meta_effects(spark, d):
    """With every block complete the design is saturated: the mean difference over blocks, and its error."""
    found = testing.meta_wls(_cube(spark, d, ["stim", "region"]), "stim", "region")
    return found.select("gene_id", r("coef").alias("coef"), r("se").alias("se"))


def _meta(block: str, least: int) -> str:
    return f"""WITH c AS (SELECT stim, {block} AS blk, gene_id, n_obs, sum(x / s) / n_obs AS mean, sqrt(greatest(sum(x / s * x / s) / n_obs - pow(sum(x / s) / n_obs, 2), 0) / n_obs) AS sem FROM counts JOIN total USING (cell_id) JOIN (SELECT stim, {block}, count(*) AS n_obs FROM total WHERE s > 0 GROUP BY ALL) USING (stim, {block}) GROUP BY stim, {block}, gene_id, n_obs),
    l AS (SELECT * FROM c WHERE blk IN (SELECT blk FROM c GROUP BY 1 HAVING count(DISTINCT stim) > 1)), v AS (SELECT *, ln(mean) AS y, pow(mean / sem, 2) AS w, stim::DOUBLE AS t FROM l WHERE n_obs > {least} AND mean > 0 AND sem > 0),
    k AS (SELECT gene_id FROM v GROUP BY 1 HAVING count(*) >= 0.7 * (SELECT count(*) FROM (SELECT DISTINCT blk, stim FROM l))),
    e AS (SELECT gene_id, blk, count(*) AS n, covar_pop(t, y) / var_pop(t) AS slope, 1 / (sum(w * t * t) - sum(w * t) * sum(w * t) / sum(w)) AS v FROM v SEMI JOIN k USING (gene_id) GROUP BY gene_id, blk HAVING min(stim) <> max(stim)),
    f AS (SELECT gene_id, sum(n * slope) / sum(n) AS coef, sqrt(sum(n * n * v)) / sum(n) AS se FROM e GROUP BY 1), z AS (SELECT *, coef / se AS z FROM f)
    SELECT gene_id, round(coef, 6) + 0.0::DOUBLE AS coef, round(se, 6) AS se, round({fx.NORMAL_P.format(z='z')}, 6) AS pval FROM z"""


def _rounded_meta(found):
    return found.select("gene_id", *[r(c).alias(c) for c in ("coef", "se", "pval")])


@query(_meta("region", 20))
def h17_meta_wls(spark, d):
    return _rounded_meta(testing.meta_wls(_cube(spark, d, ["stim", "region"]), "stim", "region"))


@query(_meta("nation", 5))
def h17_meta_by_nation(spark, d):
    """With a block for each nation, of which some have no customer of one kind."""
    return _rounded_meta(testing.meta_wls(_cube(spark, d, ["stim", "nation"]), "stim", "nation", min_cells=5))


@query("WITH n AS (SELECT count(*) FILTER (stim = 0) AS n0, count(*) FILTER (stim = 1) AS n1 FROM cells), s AS (SELECT gene_id, coalesce(sum(x) FILTER (stim = 0), 0)::DOUBLE AS s0, coalesce(sum(x) FILTER (stim = 1), 0)::DOUBLE AS s1, coalesce(sum(x * x) FILTER (stim = 0), 0)::DOUBLE AS q0, coalesce(sum(x * x) FILTER (stim = 1), 0)::DOUBLE AS q1 FROM counts JOIN cells USING (cell_id) GROUP BY 1) SELECT gene_id, round(s1 / n1 - s0 / n0, 6) AS diff, round((s1 / n1 - s0 / n0) / sqrt((q0 - s0 * s0 / n0 + q1 - s1 * s1 / n1) / (n0 + n1 - 2) * (1.0::DOUBLE / n0 + 1.0::DOUBLE / n1)), 5) AS t, n0 + n1 - 2 AS df FROM s, n")
def h18_student_t(spark, d):
    found = testing.student_t(fx.counts(spark, d), fx.cells(spark, d), "stim")
    return found.select("gene_id", r("diff").alias("diff"), r("t", 5).alias("t"), "df")


@query(f"WITH n AS (SELECT count(*) FILTER (stim = 0) AS n0, count(*) FILTER (stim = 1) AS n1 FROM cells), s AS (SELECT gene_id, coalesce(sum(x) FILTER (stim = 0), 0)::DOUBLE AS s0, coalesce(sum(x) FILTER (stim = 1), 0)::DOUBLE AS s1, coalesce(sum(x * x) FILTER (stim = 0), 0)::DOUBLE AS q0, coalesce(sum(x * x) FILTER (stim = 1), 0)::DOUBLE AS q1 FROM counts JOIN cells USING (cell_id) GROUP BY 1), t AS (SELECT gene_id, (s1 / n1 - s0 / n0) / sqrt((q0 - s0 * s0 / n0 + q1 - s1 * s1 / n1) / (n0 + n1 - 2) * (1.0::DOUBLE / n0 + 1.0::DOUBLE / n1)) AS t, (n0 + n1 - 2)::DOUBLE AS df FROM s, n) SELECT gene_id, round({fx.STUDENT_P.format(t='t', df='df')}, 7) AS pval FROM t")
def h18_student_t_test(spark, d):
    return testing.student_t_test(fx.counts(spark, d), fx.cells(spark, d), "stim").select("gene_id", r("pval", 7).alias("pval"))


_RANKS = "WITH v AS (SELECT g.gene_id, stim, coalesce(x, 0) AS x FROM cells CROSS JOIN (SELECT DISTINCT gene_id FROM counts) g LEFT JOIN counts ON counts.cell_id = cells.cell_id AND counts.gene_id = g.gene_id), k AS (SELECT *, rank() OVER (PARTITION BY gene_id ORDER BY x) + (count(*) OVER (PARTITION BY gene_id, x) - 1) / 2.0::DOUBLE AS k, count(*) OVER (PARTITION BY gene_id, x) AS c FROM v), u AS (SELECT gene_id, sum(k) FILTER (stim = 1) - count(*) FILTER (stim = 1) * (count(*) FILTER (stim = 1) + 1) / 2.0::DOUBLE - count(*) FILTER (stim = 0) * count(*) FILTER (stim = 1) / 2.0::DOUBLE AS gap, sqrt(count(*) FILTER (stim = 0) * count(*) FILTER (stim = 1) / 12.0::DOUBLE * (count(*) + 1 - sum(c * c - 1.0::DOUBLE) / (count(*) * (count(*) - 1.0::DOUBLE)))) AS sd FROM k GROUP BY 1)"


@query(f"{_RANKS}, z AS (SELECT gene_id, greatest(abs(gap) - 0.5, 0)::DOUBLE / sd AS z, (gap - 0.5)::DOUBLE / sd AS up FROM u) SELECT gene_id, round({fx.NORMAL_P.format(z='z')}, 7) AS pval, round(CASE WHEN up > 0 THEN ({fx.NORMAL_P.format(z='up')}) / 2 ELSE 1 - ({fx.NORMAL_P.format(z='up')}) / 2 END, 7) AS pval_greater FROM z")
def h19_mann_whitney_test(spark, d):
    both = testing.mann_whitney_test(fx.counts(spark, d), fx.cells(spark, d), "stim")
    above = testing.mann_whitney_test(fx.counts(spark, d), fx.cells(spark, d), "stim", "greater")
    return both.select("gene_id", r("pval", 7).alias("pval")).join(above.select("gene_id", r("pval", 7).alias("pval_greater")), "gene_id")


@query("WITH v AS (SELECT g.gene_id, stim, coalesce(x, 0) AS x FROM cells CROSS JOIN (SELECT DISTINCT gene_id FROM counts) g LEFT JOIN counts ON counts.cell_id = cells.cell_id AND counts.gene_id = g.gene_id), k AS (SELECT *, rank() OVER (PARTITION BY gene_id ORDER BY x) + (count(*) OVER (PARTITION BY gene_id, x) - 1) / 2.0::DOUBLE AS k, count(*) OVER (PARTITION BY gene_id, x) AS c FROM v) SELECT gene_id, sum(k) FILTER (stim = 1) - count(*) FILTER (stim = 1) * (count(*) FILTER (stim = 1) + 1) / 2.0::DOUBLE AS u, round((sum(k) FILTER (stim = 1) - count(*) FILTER (stim = 1) * (count(*) FILTER (stim = 1) + 1) / 2.0::DOUBLE - count(*) FILTER (stim = 0) * count(*) FILTER (stim = 1) / 2.0::DOUBLE) / sqrt(count(*) FILTER (stim = 0) * count(*) FILTER (stim = 1) / 12.0::DOUBLE * (count(*) + 1 - sum(c * c - 1.0::DOUBLE) / (count(*) * (count(*) - 1.0::DOUBLE)))), 6) AS z FROM k GROUP BY 1")
def h19_mann_whitney(spark, d):
    return testing.mann_whitney(fx.counts(spark, d), fx.cells(spark, d), "stim").select("gene_id", "u", r("z").alias("z"))


@query("WITH c AS (SELECT region, s, count(*) FILTER (stim = 0) AS a0, count(*) FILTER (stim = 1) AS a1 FROM total GROUP BY ALL), e AS (SELECT region, a0, a1, abs(sum(a0) OVER w / sum(a0) OVER (PARTITION BY region) - sum(a1) OVER w / sum(a1) OVER (PARTITION BY region)) AS g FROM c WINDOW w AS (PARTITION BY region ORDER BY s)) SELECT region, round(max(g), 6) AS d, CAST(sum(a0) AS BIGINT) AS n0, CAST(sum(a1) AS BIGINT) AS n1 FROM e GROUP BY 1")
def h20_ks(spark, d):
    return testing.ks_2samp(_total(spark, d), "size_factor", "stim", ["region"]).select("region", r("d").alias("d"), "n0", "n1")


_FLAGS = "SELECT region, c_acctbal > 5000 AS a, c_mktsegment = 'BUILDING' AS b FROM customer JOIN cells ON cell_id = c_custkey"


_CROSSTAB = f"WITH n AS (SELECT region, count(*) FILTER (a AND b) AS n11, count(*) FILTER (a AND NOT b) AS n10, count(*) FILTER (NOT a AND b) AS n01, count(*) FILTER (NOT a AND NOT b) AS n00 FROM ({_FLAGS}) GROUP BY 1) SELECT *, round((n11 + n10 + n01 + n00)::DOUBLE * pow(abs(n11 * n00 - n10 * n01) - least((n11 + n10 + n01 + n00) / 2.0::DOUBLE, abs(n11 * n00 - n10 * n01)), 2) / nullif((n11 + n10)::DOUBLE * (n01 + n00) * (n11 + n01) * (n10 + n00), 0), 6) AS chi2 FROM n"


@query(_CROSSTAB)
def h21_crosstab(spark, d):
    return testing.crosstab(_flags(spark, d), "a", "b", ["region"]).withColumn("chi2", r("chi2"))


def _flags(spark, d):
    rows = fx.cells(spark, d).join(table(spark, d, "customer"), F.col("cell_id") == F.col("c_custkey"))
    return rows.select("region", (F.col("c_acctbal") > 5000).alias("a"), (F.col("c_mktsegment") == "BUILDING").alias("b"), "seg")


_CHI2_P = f"WITH n AS (SELECT region, count(*) FILTER (a AND b) AS w, count(*) FILTER (a AND NOT b) AS x, count(*) FILTER (NOT a AND b) AS y, count(*) FILTER (NOT a AND NOT b) AS v FROM ({_FLAGS}) GROUP BY 1), c AS (SELECT region, sqrt((w + x + y + v)::DOUBLE * pow(abs(w * v - x * y) - least((w + x + y + v) / 2.0::DOUBLE, abs(w * v - x * y)), 2) / nullif((w + x)::DOUBLE * (y + v) * (w + y) * (x + v), 0)) AS z FROM n) SELECT region, CASE WHEN z IS NOT NULL THEN round({fx.NORMAL_P.format(z='z')}, 7) END AS pval FROM c"


@query(_CHI2_P)
def h21_chi2_pvalue(spark, d):
    return testing.crosstab_test(_flags(spark, d), "a", "b", ["region"]).select("region", r("chi2_pval", 7).alias("pval"))


@query("WITH n AS (SELECT seg, region, count(*) AS n FROM cells GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY seg) * sum(n) OVER (PARTITION BY region) / sum(n) OVER () AS e, sum(n) OVER () AS a FROM n) SELECT round(sum(pow(n - e, 2) / e - e) + any_value(a), 5) AS chi2, (count(DISTINCT seg) - 1) * (count(DISTINCT region) - 1) AS df FROM t")
def h21_chi2_table(spark, d):
    return testing.chi2_table(fx.cells(spark, d), "seg", "region").select(r("chi2", 5).alias("chi2"), "df")


@query("SELECT seg, count(*) FILTER (c_acctbal > 5000) AS k, count(*) AS n FROM customer JOIN cells ON cell_id = c_custkey GROUP BY 1")
def h22_binomial(spark, d):
    return testing.binomial_test(_flags(spark, d), "a", ["seg"]).select("seg", "k", "n")


@query("WITH c AS (SELECT seg, count(*) FILTER (c_acctbal > 5000) AS k, count(*) AS n FROM customer JOIN cells ON cell_id = c_custkey GROUP BY 1), p AS (SELECT *, [exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)) FOR i IN range(n + 1)] AS p FROM c) SELECT seg, round(least(1, list_sum([v FOR v IN p IF v <= p[k + 1] * (1 + 1e-7)])), 8) AS pval FROM p")
def h22_binomial_test(spark, d):
    return testing.binomial_test(_flags(spark, d), "a", ["seg"]).select("seg", r("pval", 8).alias("pval"))


_FISHER = f"WITH n AS (SELECT region, count(*) FILTER (a AND b) AS n11, count(*) FILTER (a) AS r, count(*) FILTER (b) AS c, count(*) AS n FROM ({_FLAGS}) GROUP BY 1), p AS (SELECT *, greatest(0, r + c - n) AS low, [exp(lgamma(r + 1) - lgamma(i + 1) - lgamma(r - i + 1) + lgamma(n - r + 1) - lgamma(c - i + 1) - lgamma(n - r - c + i + 1) - lgamma(n + 1) + lgamma(c + 1) + lgamma(n - c + 1)) FOR i IN range(greatest(0, r + c - n), least(r, c) + 1)] AS p FROM n) SELECT region, round(least(1, list_sum([v FOR v IN p IF v <= p[n11 - low + 1] * (1 + 1e-7)])), 8) AS pval FROM p"


@query(_FISHER)
def h21_fisher(spark, d):
    return testing.crosstab_test(_flags(spark, d), "a", "b", ["region"]).select("region", r("fisher_pval", 8).alias("pval"))


@query(f"SELECT c.*, p.pval AS chi2_pval, f.pval AS fisher_pval FROM ({_CROSSTAB}) c JOIN ({_CHI2_P}) p USING (region) JOIN ({_FISHER}) f USING (region)")
def h21_crosstab_tests(spark, d):
    found = testing.crosstab_test(_flags(spark, d), "a", "b", ["region"])
    return found.withColumns({"chi2": r("chi2"), "chi2_pval": r("chi2_pval", 7), "fisher_pval": r("fisher_pval", 8)})


_EXPR = "SELECT gene_id, nation, ln(1 + coalesce(sum(x), 0) / any_value(n)) AS v FROM (SELECT nation, count(*) AS n FROM cells GROUP BY 1) CROSS JOIN (SELECT DISTINCT gene_id FROM counts) LEFT JOIN (SELECT nation, gene_id, x FROM counts JOIN cells USING (cell_id)) USING (nation, gene_id) GROUP BY ALL"


def _association(spark, d):
    cells = fx.cells(spark, d).withColumn("individual", F.col("nation").cast("string"))
    expression = materialize(estimators.pseudobulk_table(materialize(fx.counts(spark, d)), cells, ["individual"], "log_mean"))
    genotypes = materialize(fx.genotypes(spark, d))
    return expression, genotypes, expression.select("gene_id").distinct().crossJoin(genotypes.select("snp").distinct())


@query(f"WITH e AS ({_EXPR}) SELECT gene_id, snp, round(regr_slope(v, dosage), 6) + 0.0::DOUBLE AS beta, count(*) - 2 AS df FROM e JOIN genotypes ON individual = CAST(nation AS VARCHAR) GROUP BY ALL HAVING var_pop(dosage) > 1e-9")
def h23_pseudobulk_linear(spark, d):
    return testing.pseudobulk_linear(*_association(spark, d)).select("gene_id", "snp", r("beta").alias("beta"), "df")


_ASSOCIATED = f"WITH e AS ({_EXPR}), s AS (SELECT gene_id, snp, count(*) AS n, var_pop(dosage) * count(*) AS gg, var_pop(v) * count(*) AS yy, var_pop(value) * count(*) AS cc, covar_pop(v, dosage) * count(*) AS gy, covar_pop(dosage, value) * count(*) AS gc, covar_pop(v, value) * count(*) AS cy FROM e JOIN genotypes ON individual = CAST(nation AS VARCHAR) JOIN covariates USING (individual) GROUP BY ALL), f AS (SELECT gene_id, snp, n - 3 AS df, gg - gc * gc / cc AS g2, gy - gc * cy / cc AS g1, yy - cy * cy / cc AS y2 FROM s), t AS (SELECT gene_id, snp, df, g1 / g2 AS beta, g1 / g2 / sqrt((y2 - g1 * g1 / g2) / df / g2) AS t FROM f WHERE g2 > 1e-9)"


@query(f"{_ASSOCIATED}, p AS (SELECT *, {fx.STUDENT_P.format(t='t', df='df')} AS p FROM t), k AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM p) SELECT gene_id, snp, round(beta, 6) + 0.0::DOUBLE AS beta, round(t, 5) + 0.0::DOUBLE AS t, df, round(p, 7) AS pval, round(least(1, min(p * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS fdr FROM k")
def h23_cis_association(spark, d):
    """With a covariate."""
    found = testing.cis_association(*_association(spark, d), fx.covariates(spark, d))
    return found.select("gene_id", "snp", r("beta").alias("beta"), r("t", 5).alias("t"), "df", r("pval", 7).alias("pval"), r("fdr").alias("fdr"))


def _wls(spark, d):
    cube = _cube(spark, d, ["seg", "region"]).withColumn("grp", F.concat_ws("^", "seg", "region"))
    design = cube.select("grp", (F.col("seg") == "BUILDING").cast("double").alias("stim")).distinct().orderBy("grp").toPandas()
    return testing.log1p_wls(cube, design, ["stim"])




_WLS = "WITH c AS (SELECT seg, region, gene_id, sum(x / s) / n_obs AS mean, sqrt(greatest(sum(x / s * x / s) / n_obs - pow(sum(x / s) / n_obs, 2), 0) / n_obs) AS sem FROM counts JOIN total USING (cell_id) JOIN (SELECT seg, region, count(*) AS n_obs FROM total WHERE s > 0 GROUP BY ALL) USING (seg, region) GROUP BY seg, region, gene_id, n_obs), e AS (SELECT gene_id, (seg = 'BUILDING')::INT::DOUBLE AS t, ln(1 + mean) AS y, (ln(1 + mean + sem) - ln(1 + greatest(mean - sem, -0.999999))) / 2 AS se FROM c), w AS (SELECT *, pow(CASE WHEN se > 0 THEN se ELSE min(se) FILTER (se > 0) OVER (PARTITION BY gene_id) END, -2) AS w FROM e), s AS (SELECT gene_id, sum(w) AS w, sum(w * t) AS wt, sum(w * y) AS wy, sum(w * t * t) AS wtt, sum(w * t * y) AS wty FROM w WHERE w IS NOT NULL GROUP BY 1), f AS (SELECT gene_id, 'stim' AS tx, (w * wty - wt * wy) / (w * wtt - wt * wt) AS coef, sqrt(w / (w * wtt - wt * wt)) AS se FROM s WHERE w * wtt - wt * wt > 1e-9 * w * wtt)"


@query(f"{_WLS} SELECT gene_id, tx, round(coef, 8) + 0.0::DOUBLE AS coef, round(se, 8) AS se FROM f")
def h24_log1p_effects(spark, d):
    return _wls(spark, d).filter("se > 0").select("gene_id", "tx", r("coef", 8).alias("coef"), r("se", 8).alias("se"))


@query(f"{_WLS}, z AS (SELECT *, coef / se AS z FROM f) SELECT gene_id, tx, round(coef, 8) + 0.0::DOUBLE AS coef, round(se, 8) AS se, round({fx.NORMAL_P.format(z='z')}, 6) AS pval FROM z")
def h24_log1p_wls(spark, d):
    return _wls(spark, d).select("gene_id", "tx", r("coef", 8).alias("coef"), r("se", 8).alias("se"), r("pval").alias("pval"))


# Multiple testing and evaluation


def _bh(by):
    part = f"PARTITION BY {by}" if by else ""
    order = f"PARTITION BY {by} ORDER BY k" if by else "ORDER BY k"
    return f"WITH k AS (SELECT *, row_number() OVER ({part} ORDER BY pval) AS k, count(*) OVER ({part}) AS m FROM tests) SELECT key, round(least(1, min(pval * m / k) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 8) AS fdr FROM k"


@query(_bh(""))
def p1_bh_fdr(spark, d):
    return pvalues.bh_fdr(fx.tests(spark, d)).select("key", r("fdr", 8).alias("fdr"))


@query(_bh("family"))
def p1_bh_fdr_by_family(spark, d):
    return pvalues.bh_fdr(fx.tests(spark, d), by=["family"]).select("key", r("fdr", 8).alias("fdr"))


@query("WITH k AS (SELECT *, row_number() OVER (ORDER BY pval) AS k, count(*) OVER () AS m, count(*) FILTER (pval > 0.89) OVER () AS h FROM tests) SELECT key, round(least(1, CASE WHEN m < 100 THEN 1 ELSE least(1, h / (0.11::DOUBLE * m)) END * min(pval * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 8) AS qvalue FROM k")
def p2_storey(spark, d):
    return pvalues.storey_qvalue(fx.tests(spark, d)).select("key", r("qvalue", 8).alias("qvalue"))


@query("WITH s AS (SELECT family, gene, -2 * sum(ln(pval)) AS chi2, count(*) AS k FROM (SELECT *, key % 40 AS gene FROM tests) GROUP BY ALL) SELECT family, gene, round(chi2, 6) AS chi2, k, round(exp(-chi2 / 2) * list_sum([pow(chi2 / 2, i) / gamma(i + 1) FOR i IN range(k)]), 8) AS pval FROM s")
def p3_fisher_combine(spark, d):
    rows = fx.tests(spark, d).withColumn("gene", F.col("key") % 40)
    return pvalues.fisher_combine(rows, "pval", ["family", "gene"]).select("family", "gene", r("chi2").alias("chi2"), "k", r("pval", 8).alias("pval"))


@query("WITH k AS (SELECT pval, row_number() OVER (ORDER BY pval) AS rank, count(*) OVER () AS m FROM tests) SELECT rank, round(-log10(pval), 6) AS observed, CASE WHEN rank > 1 THEN round(-log10((rank - 1) / (m - 1)), 6) END AS expected FROM k")
def p4_qq_points(spark, d):
    found = pvalues.qq_points(fx.tests(spark, d))
    return found.select(F.col("rank").cast("long").alias("rank"), r("observed").alias("observed"), r("expected").alias("expected"))


_GRID = [i / 20 for i in range(1, 20)]
_STEPS = "(SELECT unnest(range(1, 20)) / 20.0::DOUBLE AS threshold)"


@query(f"SELECT method, threshold, count(*) FILTER (gene_id % 10 = 0 AND pval < threshold) AS recovered, round(count(*) FILTER (gene_id % 10 = 0 AND pval < threshold) / count(*) FILTER (gene_id % 10 = 0), 6) AS power, round(1 - count(*) FILTER (gene_id % 10 = 0 AND pval < threshold) / nullif(count(*) FILTER (pval < threshold), 0), 6) AS false_discoveries FROM results, {_STEPS} GROUP BY ALL")
def p5_power_curve(spark, d):
    truth = fx.results(spark, d).filter("gene_id % 10 = 0").select("gene_id").distinct()
    found = pvalues.power_curve(fx.results(spark, d), truth, ["gene_id"], "pval", ["method"], _GRID)
    return found.select("method", "threshold", "recovered", r("power").alias("power"), r("false_discoveries").alias("false_discoveries"))


@query(f"WITH c AS (SELECT method, threshold, count(*) FILTER (pval < threshold) / count(*) AS rate FROM results, {_STEPS} GROUP BY ALL), a AS (SELECT method, (threshold - lag(threshold) OVER w) * (rate + lag(rate) OVER w) / 2 AS a FROM c WINDOW w AS (PARTITION BY method ORDER BY threshold)) SELECT method, round(sum(a), 6) AS auc FROM a GROUP BY 1")
def p6_roc_auc(spark, d):
    curve = pvalues.threshold_curve(fx.results(spark, d), "pval", ["method"], _GRID)
    return pvalues.roc_auc(curve, "threshold", "rate", ["method"]).withColumn("auc", r("auc"))


@query("SELECT method, round(avg((pval < 0.05)::INT) FILTER (gene_id % 10 = 0), 6) AS tpr, round(avg((pval < 0.05)::INT) FILTER (gene_id % 10 <> 0), 6) AS fpr FROM results GROUP BY 1")
def p7_tpr_fpr(spark, d):
    return pvalues.tpr_fpr(fx.results(spark, d), F.col("gene_id") % 10 == 0, "pval", 0.05, ["method"]).select("method", r("tpr").alias("tpr"), r("fpr").alias("fpr"))


@query("WITH k AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY pval, gene_id) AS k FROM results), t AS (SELECT * FROM k WHERE k <= 100) SELECT a.method, round(sum(101 - greatest(a.k, b.k)) / (2 * 100 * 101 / 2.0::DOUBLE), 6) AS auc FROM t a JOIN t b USING (gene_id) WHERE b.method IN ('m1', 'm2') GROUP BY 1")
def p8_concordance_auc(spark, d):
    return pvalues.concordance_auc(fx.results(spark, d), ["m1", "m2"], 100).withColumn("auc", r("auc"))


@query("WITH k AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY pval, gene_id) AS k FROM results), n AS (SELECT a.method, greatest(a.k, b.k) AS i FROM k a JOIN k b USING (gene_id) WHERE b.method = 'm1') SELECT method, g.i AS i, count(*) FILTER (n.i <= g.i) AS overlap FROM n, (SELECT CAST(unnest(range(1, 51)) AS INT) AS i) g GROUP BY ALL")
def p8_concordance_curve(spark, d):
    return pvalues.concordance_curve(fx.results(spark, d), "m1", 50)


@query("SELECT gene_id FROM results WHERE gene_id % 3 <> 0 OR method <> 'm2' GROUP BY 1 HAVING count(DISTINCT method) = 3")
def p9_common_keys(spark, d):
    return pvalues.common_keys(fx.results(spark, d).filter("gene_id % 3 <> 0 or method <> 'm2'"), "gene_id", "method")


@query("SELECT gene_id % 5 AS block, count(*) FILTER (method = 'm1' AND pval < 0.1) AS m1, count(*) FILTER (method = 'm2' AND pval < 0.1) AS m2, count(*) FILTER (method = 'm3' AND pval < 0.1) AS m3 FROM results GROUP BY 1")
def p10_hit_summary(spark, d):
    return pvalues.hit_summary(fx.results(spark, d).withColumn("block", F.col("gene_id") % 5), "block", "method", ["m1", "m2", "m3"], F.col("pval") < 0.1)


@query("SELECT CASE WHEN least(a, b, c) > 0 THEN 'up' WHEN greatest(a, b, c) < 0 THEN 'down' ELSE 'mixed' END AS class, count(*) AS n FROM (SELECT gene_id, max(coef) FILTER (method = 'm1') AS a, max(coef) FILTER (method = 'm2') AS b, max(coef) FILTER (method = 'm3') AS c FROM results GROUP BY 1) GROUP BY 1")
def p10_sign_classes(spark, d):
    wide = fx.results(spark, d).groupBy("gene_id").pivot("method", ["m1", "m2", "m3"]).agg(F.max("coef"))
    return wide.groupBy(pvalues.sign_class(["m1", "m2", "m3"]).alias("class")).agg(F.count("*").alias("n"))


_ENRICHMENT = 'SELECT p_type AS "set", count(DISTINCT p_partkey) FILTER (p_partkey % 7 = 0) AS overlap, count(DISTINCT p_partkey) AS set_size, (SELECT count(*) FROM part WHERE p_partkey % 7 = 0) AS hits, (SELECT count(*) FROM part) AS universe FROM part GROUP BY 1'


@query(_ENRICHMENT)
def p11_enrichment_counts(spark, d):
    genes = table(spark, d, "part").select(F.col("p_partkey").alias("gene_id"), F.col("p_type").alias("set"))
    return pvalues.enrichment_counts(genes.filter("gene_id % 7 = 0"), genes, genes).select("set", "overlap", "set_size", "hits", "universe")


_ENRICHED = 'WITH c AS (SELECT p_type AS t, count(*) FILTER (p_partkey % 7 = 0) AS k, count(*) AS m, (SELECT count(*) FROM part WHERE p_partkey % 7 = 0) AS d, (SELECT count(*) FROM part) AS n FROM part GROUP BY 1) SELECT t AS "set", round(least(1, list_sum([exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) + lgamma(n - m + 1) - lgamma(d - i + 1) - lgamma(n - m - d + i + 1) - lgamma(n + 1) + lgamma(d + 1) + lgamma(n - d + 1)) FOR i IN range(greatest(k, 0, d + m - n), least(m, d) + 1)])), 7) AS pval FROM c'


@query(_ENRICHED)
def p11_enrichment_pvalue(spark, d):
    return _enrichment(spark, d).select("set", r("pval", 7).alias("pval"))


_ENRICHMENT_FDR = f"WITH e AS ({_ENRICHED.replace(', 7) AS pval', ', 12) AS pval')}), k AS (SELECT *, row_number() OVER (ORDER BY pval) AS k, count(*) OVER () AS m FROM e) SELECT \"set\", round(pval, 7) AS pval, round(least(1, min(pval * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 7) AS fdr FROM k"


@query(_ENRICHMENT_FDR)
def p11_enrichment_fdr(spark, d):
    return _enrichment(spark, d).select("set", r("pval", 7).alias("pval"), r("fdr", 7).alias("fdr"))


@query(f"SELECT c.*, f.pval, f.fdr FROM ({_ENRICHMENT}) c JOIN ({_ENRICHMENT_FDR}) f USING (\"set\")")
def p11_enrichment_test(spark, d):
    found = _enrichment(spark, d)
    return found.withColumns({"pval": r("pval", 7), "fdr": r("fdr", 7)})


def _enrichment(spark, d):
    genes = table(spark, d, "part").select(F.col("p_partkey").alias("gene_id"), F.col("p_type").alias("set"))
    return pvalues.enrichment_test(genes.filter("gene_id % 7 = 0"), genes, genes)


@query("SELECT snp, min(n) AS min_count, round(min(n) / sum(n), 6) AS min_freq FROM (SELECT p_size AS snp, p_partkey % 3 AS dosage, count(*) AS n FROM part GROUP BY ALL) GROUP BY 1")
def p12_minor_class(spark, d):
    genotypes = table(spark, d, "part").select(F.col("p_size").alias("snp"), (F.col("p_partkey") % 3).alias("dosage"))
    return pvalues.minor_class(genotypes).withColumn("min_freq", r("min_freq"))


# Joins and intervals


@query("SELECT gene_id, a.coef AS coef_m1, a.pval AS pval_m1, b.coef AS coef_m2, b.pval AS pval_m2 FROM (SELECT * FROM results WHERE method = 'm1' AND pval < 0.5) a FULL JOIN (SELECT * FROM results WHERE method = 'm2' AND pval < 0.3) b USING (gene_id)")
def j1_outer_merge(spark, d):
    rows = fx.results(spark, d)
    pick = lambda m, p: rows.filter((F.col("method") == m) & (F.col("pval") < p)).select("gene_id", "coef", "pval")
    return tables.outer_merge({"m1": pick("m1", 0.5), "m2": pick("m2", 0.3)}, "gene_id")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AS big FROM customer")
def j2_semi_anti(spark, d):
    customer, big = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").filter("o_totalprice > 200000")
    on = F.col("c_custkey") == F.col("o_custkey")
    return customer.join(big, on, "left_semi").withColumn("big", F.lit(True)).union(customer.join(big, on, "left_anti").withColumn("big", F.lit(False)))


@query("SELECT a.g AS gene_1, b.g AS gene_2 FROM (SELECT DISTINCT gene_id AS g FROM counts) a JOIN (SELECT DISTINCT gene_id AS g FROM counts) b ON a.g < b.g")
def j3_unordered_pairs(spark, d):
    return tables.unordered_pairs(fx.counts(spark, d).select("gene_id").distinct())


@query("SELECT a.p_partkey AS gene_1, b.s_suppkey AS gene_2 FROM part a, supplier b WHERE p_partkey <> s_suppkey")
def j3_product_pairs(spark, d):
    parts, suppliers = table(spark, d, "part").select(F.col("p_partkey").alias("gene_id")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("gene_id"))
    return tables.product_pairs(parts, suppliers, refuse=False)


@query("SELECT r.g AS regulator, t.g AS target, 's' || t.k AS snp FROM (SELECT DISTINCT gene_id AS g FROM counts) r JOIN (SELECT DISTINCT gene_id AS g, cell_id % 3 AS k FROM counts) t ON r.g <> t.g")
def j4_regulator_triples(spark, d):
    counts = materialize(fx.counts(spark, d))
    regulators = counts.select(F.col("gene_id").alias("regulator")).distinct()
    snps = counts.select(F.col("gene_id").alias("target"), F.concat(F.lit("s"), F.col("cell_id") % 3).alias("snp")).distinct()
    return tables.regulator_triples(regulators, snps)


@query("SELECT gene_1, gene_2, a.t AS gene_1_total, b.t AS gene_2_total, a.t - b.t AS difference FROM pairs LEFT JOIN (SELECT gene_id, CAST(sum(x) AS BIGINT) AS t FROM counts GROUP BY 1) a ON a.gene_id = gene_1 LEFT JOIN (SELECT gene_id, CAST(sum(x) AS BIGINT) AS t FROM counts GROUP BY 1) b ON b.gene_id = gene_2")
def j5_two_role_lookup(spark, d):
    totals = fx.counts(spark, d).groupBy("gene_id").agg(F.sum("x").alias("total"))
    return tables.two_role_lookup(_pairs(spark, d), totals, "gene_1", "gene_2", "gene_id", "total")


@query('SELECT a.name AS a_name, b.name AS b_name, a.chrom, greatest(a."start", b."start") AS "start", least(a."end", b."end") AS "end" FROM points a JOIN intervals b ON a.chrom = b.chrom AND a."start" < b."end" AND b."start" < a."end"')
def r1_interval_overlap(spark, d):
    return intervals.interval_overlap(fx.points(spark, d), fx.intervals(spark, d), width=50)


@query('SELECT DISTINCT a.name AS a_name, b.name AS b_name FROM intervals a JOIN points b ON a.chrom = b.chrom AND greatest(a."start" - 30, 0) < b."end" AND b."start" < a."end" + 30')
def r2_interval_window(spark, d):
    return intervals.interval_window(fx.intervals(spark, d), fx.points(spark, d), 30, width=50)


@query('SELECT a.name AS a_name, min(CASE WHEN a."start" < b."end" AND b."start" < a."end" THEN 0 WHEN b."end" <= a."start" THEN a."start" - b."end" + 1 ELSE b."start" - a."end" + 1 END) AS distance FROM points a LEFT JOIN intervals b ON a.chrom = b.chrom GROUP BY 1')
def r3_interval_closest(spark, d):
    return intervals.interval_closest(fx.points(spark, d), fx.intervals(spark, d), width=70).select("a_name", "distance")


@query('WITH o AS (SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM intervals), i AS (SELECT *, sum(CASE WHEN reached IS NULL OR "start" > reached THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT chrom, min("start") AS "start", max("end") AS "end", count(*) AS n FROM i GROUP BY chrom, k')
def r4_interval_union(spark, d):
    return intervals.interval_union(fx.intervals(spark, d), width=90)


def _genes(spark, d):
    rows = fx.intervals(spark, d)
    return rows.select("chrom", F.col("start").alias("tx_start"), F.col("end").alias("tx_end"), F.when(F.col("start") % 2 == 0, "+").otherwise("-").alias("strand"), F.concat(F.lit("g"), F.col("name").cast("int") % 30).alias("symbol"))


_GENES = "(SELECT chrom, \"start\" AS s, \"end\" AS e, 'g' || (name::INT % 30) AS symbol FROM intervals)"


@query(f'SELECT chrom, greatest((CASE WHEN s % 2 = 0 THEN s ELSE e END) - 40, 0) AS "start", (CASE WHEN s % 2 = 0 THEN s ELSE e END) + 40 AS "end", symbol AS name FROM {_GENES}')
def r5_tss_window(spark, d):
    return intervals.tss_window(_genes(spark, d), 40)


@query(f'SELECT symbol, chrom, min(s) AS "start", max(e) AS "end" FROM {_GENES} GROUP BY 1, 2')
def r5_gene_extent(spark, d):
    return intervals.gene_extent(_genes(spark, d))


@query(f'SELECT name, symbol, min(abs("start" - s)) AS to_start, min(abs("start" - e)) AS to_end, min(abs("start" - s)) < 50 AS near_start, min(abs("start" - e)) < 50 AS near_end FROM points JOIN {_GENES} USING (chrom) WHERE abs("start" - s) < 200 GROUP BY 1, 2')
def r6_distance_to_ends(spark, d):
    points = fx.points(spark, d).withColumn("pos", F.col("start"))
    genes = _genes(spark, d)
    starts = genes.select("chrom", F.col("tx_start").alias("start"), (F.col("tx_start") + 1).alias("end"), F.monotonically_increasing_id().cast("string").alias("name"), "symbol", "tx_start", "tx_end")
    starts = materialize(starts)
    near = intervals.interval_window(points.select("chrom", "start", "end", "name"), starts.select("chrom", "start", "end", "name"), 199, width=200)
    pairs = near.join(starts.withColumnRenamed("name", "b_name"), "b_name").select(F.col("a_name").alias("name"), "symbol", "chrom", "tx_start", "tx_end")
    near = pairs.select("symbol", "chrom", "tx_start", "tx_end").distinct()
    found = intervals.distance_to_ends(pairs.select("name", "symbol").distinct(), points, near, 50)
    return found


# Aggregations, windows, order, sets, shapes


@query('SELECT gene_id, CAST(sum(x) AS BIGINT) AS total, round(avg(x), 6) AS mean, median(x) AS median, min(x) AS "least", max(x) AS most, count(DISTINCT x) AS values FROM counts GROUP BY 1')
def a1_aggregates(spark, d):
    return fx.counts(spark, d).groupBy("gene_id").agg(F.sum("x").alias("total"), r(F.avg("x")).alias("mean"), F.median("x").alias("median"), F.min("x").alias("least"), F.max("x").alias("most"), F.count_distinct("x").alias("values"))


@query("SELECT x, count(*) AS n, count(DISTINCT gene_id) AS genes FROM counts GROUP BY 1")
def a2_value_counts(spark, d):
    return fx.counts(spark, d).groupBy("x").agg(F.count("*").alias("n"), F.count_distinct("gene_id").alias("genes"))


@query("SELECT key, round(pval - avg(pval) OVER (PARTITION BY family), 6) AS gap FROM tests")
def a3_group_mean(spark, d):
    return tables.with_group_mean(fx.tests(spark, d), ["family"], "pval", "mean").select("key", r(F.col("pval") - F.col("mean")).alias("gap"))


@query("SELECT key, rank() OVER (ORDER BY key % 50) + (count(*) OVER (PARTITION BY key % 50) - 1) / 2.0::DOUBLE AS avg_rank FROM tests")
def w2_average_rank(spark, d):
    rows = fx.tests(spark, d).withColumn("v", F.col("key") % 50)
    return average_rank(rows, [], "v", "avg_rank").select("key", "avg_rank")


@query("SELECT key, family, rank() OVER (PARTITION BY family ORDER BY key % 9) + (count(*) OVER (PARTITION BY family, key % 9) - 1) / 2.0::DOUBLE AS avg_rank FROM tests")
def n5_average_rank_by_group(spark, d):
    rows = fx.tests(spark, d).withColumn("v", F.col("key") % 9)
    return average_rank(rows, ["family"], "v", "avg_rank").select("key", "family", "avg_rank")


@query("SELECT family, key, pval, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY pval, key) AS k FROM tests) WHERE k <= 3")
def t1_top_per_group(spark, d):
    return tables.top_per_group(fx.tests(spark, d), ["family"], [F.col("pval"), F.col("key")], 3)


@query("SELECT key, pval FROM tests ORDER BY pval, key LIMIT 25")
def t1_smallest(spark, d):
    return fx.tests(spark, d).select("key", "pval").orderBy("pval", "key").limit(25)


@query("SELECT 'customer' AS kind, c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier")
def u1_labelled_union(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return pvalues.outer_union({"customer": c, "supplier": s}, "kind").select("kind", "nation", "balance")


@query("(SELECT 'both' AS side, gene_id FROM results WHERE method = 'm1' AND pval < 0.2 INTERSECT SELECT 'both', gene_id FROM results WHERE method = 'm2' AND pval < 0.2) UNION ALL (SELECT 'first', gene_id FROM results WHERE method = 'm1' AND pval < 0.2 EXCEPT SELECT 'first', gene_id FROM results WHERE method = 'm2' AND pval < 0.2)")
def u2_set_operations(spark, d):
    pick = lambda m: fx.results(spark, d).filter((F.col("method") == m) & (F.col("pval") < 0.2)).select("gene_id")
    both, first = pick("m1").intersect(pick("m2")), pick("m1").subtract(pick("m2"))
    return both.select(F.lit("both").alias("side"), "gene_id").union(first.select(F.lit("first").alias("side"), "gene_id"))


@query("SELECT gene_id, max(coef) FILTER (method = 'm1') AS m1_coef, round(max(pval) FILTER (method = 'm1'), 6) AS m1_pval, max(coef) FILTER (method = 'm2') AS m2_coef, round(max(pval) FILTER (method = 'm2'), 6) AS m2_pval FROM results GROUP BY 1")
def x1_pivot(spark, d):
    rows = fx.results(spark, d).withColumn("pval", r("pval"))
    return meanvar.wide(rows, ["gene_id"], "method", ["m1", "m2"], ["coef", "pval"])


@query("SELECT cell_id, round((seg = 'BUILDING')::INT - avg((seg = 'BUILDING')::INT) OVER (), 6) AS b, round(((seg = 'BUILDING')::INT - avg((seg = 'BUILDING')::INT) OVER ()) * stim, 6) AS inter, 1.0::DOUBLE AS const FROM cells")
def x2_one_hot(spark, d):
    design = tables.one_hot(fx.cells(spark, d), "seg", ["AUTOMOBILE", "BUILDING"], centre=True)
    design = tables.with_interactions(design, ["seg_BUILDING"], ["stim"])
    return design.select("cell_id", r("seg_BUILDING").alias("b"), r(F.col("`seg_BUILDING:stim`")).alias("inter"), "const")


@query("WITH e AS (SELECT gene_1, gene_2 FROM corrs WHERE grp = 'sg^BUILDING' AND gene_1 < gene_2 AND abs(corr) >= 0.01) SELECT g AS gene_id, count(*) AS degree FROM (SELECT gene_1 AS g FROM e UNION ALL SELECT gene_2 FROM e) GROUP BY 1")
def x3_node_degree(spark, d):
    pairs = _pair_moments(spark, d).filter("grp = 'sg^BUILDING' and gene_1 < gene_2")
    return tables.node_degree(tables.edge_list(pairs, "corr", 0.01))


@query("SELECT p_partkey, round(least(greatest(ln(p_retailprice) - 7, -0.2), 0.2), 6) AS clipped, round(log10(p_size) + exp(-p_size) + sqrt(p_size) + pow(p_size, 0.3), 6) AS mixed, CASE WHEN p_size >= p_partkey % 40 THEN 'a' ELSE 'b' END AS larger FROM part")
def n1_n4_scalars(spark, d):
    from ..functions.columns import clip

    rows = table(spark, d, "part").withColumns({"a": F.col("p_size").cast("long"), "b": F.col("p_partkey") % 40})
    mixed = F.log10("p_size") + F.exp(-F.col("p_size")) + F.sqrt("p_size") + F.pow("p_size", F.lit(0.3))
    return rows.select("p_partkey", r(clip(F.log("p_retailprice") - 7, -0.2, 0.2)).alias("clipped"), r(mixed).alias("mixed"), argmax_column(["a", "b"]).alias("larger"))
