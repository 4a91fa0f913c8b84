"""Multiple testing, combination of p-values, and scores of result lists against truth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from ..functions.columns import as_null, running_before
from ..functions.lineage import materialize

#: Rows of one p that a task puts out.
_TIES = 1 << 16
#: Sums beyond it are scaled down.
_LARGE = 1e200


def _ranked(df: DataFrame, p: str, by: list[str]) -> DataFrame:
    """``by``, ``_p``, ``_n``, ``_before`` and ``_m`` for each distinct p of a family: rows that have it, rows of a
    smaller one, and all rows. Equal ones are counted first, so that a p of very many rows costs as much as any other."""
    rows = df.withColumn("_p", as_null(F.col(p).cast("double"))).filter("_p is not null")
    counts = rows.groupBy(*by, "_p").agg(F.count("*").alias("_n"))
    placed = running_before(counts, by, ["_p"], {"_before": F.col("_n")})
    return _beside(placed, placed.groupBy(*by).agg(F.max(F.col("_before") + F.col("_n")).alias("_m")), by)


def _beside(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Join on ``keys`` of which some may be null."""
    named = found.select(*[F.col(c).alias(f"_by_{c}") if c in keys else F.col(c) for c in found.columns])
    if not keys:
        return rows.crossJoin(F.broadcast(named))  # one row
    return rows.join(named, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in keys]).drop(*[f"_by_{c}" for c in keys])


def _step_up(df: DataFrame, p: str, by: list[str]) -> DataFrame:
    """Rows with a p-value and ``_step``: the least p * m / rank among equal and larger ones, the rank of equal
    ones being that of the last. Ranges of p are gone through in parallel, each with the least of those after it."""
    ranked = _ranked(df, p, by).withColumn("_value", F.col("_p") * F.col("_m") / (F.col("_before") + F.col("_n")))
    ranged = materialize(ranked.repartitionByRange(*by, "_p").withColumn("_range", F.spark_partition_id()))
    after = Window.partitionBy(*by).orderBy("_range").rowsBetween(1, Window.unboundedFollowing)
    least = ranged.groupBy(*by, "_range").agg(F.min("_value").alias("_least")).select(*by, "_range", F.min("_least").over(after).alias("_later"))
    own = Window.partitionBy(*by, "_range").orderBy("_p").rowsBetween(0, Window.unboundedFollowing)
    stepped = _beside(ranged.withColumn("_step", F.min("_value").over(own)), least, [*by, "_range"])
    steps = materialize(stepped.select(*by, "_p", F.least("_step", "_later").alias("_step")))
    return _beside(df.withColumn("_p", as_null(F.col(p).cast("double"))).filter("_p is not null"), steps, [*by, "_p"])


def _back(df: DataFrame, p: str, out: str, found: DataFrame, missing: float | None) -> DataFrame:
    rest = df.filter(as_null(F.col(p).cast("double")).isNull()).withColumn(out, F.lit(missing).cast("double"))
    return found.select(*df.columns, out).unionByName(rest)


def bh_fdr(df: DataFrame, p: str = "pval", by: list[str] | None = None, out: str = "fdr") -> DataFrame:
    """P1. Benjamini-Hochberg within each family; a missing p has fdr 1 and isn't counted."""
    df = materialize(df)
    found = _step_up(df, p, by or []).withColumn(out, F.least("_step", F.lit(1.0)))
    return _back(df, p, out, found, 1.0)


def storey_qvalue(df: DataFrame, p: str = "pval", pi0: float | None = None, out: str = "qvalue") -> DataFrame:
    """P2. pi0 is given, or 1 for fewer than 100 tests, or the share of p above 0.89 over 0.11, at most
    1: what a spline through all of lambda = 0, 0.01 .. 0.89 is at its last knot."""
    df = materialize(df)
    found = _step_up(df, p, [])
    share = F.lit(pi0)
    if pi0 is None:
        m = df.filter(as_null(F.col(p).cast("double")).isNotNull()).agg(F.count("*").alias("_all"), F.count_if(F.col(p) > 0.89).alias("_high"))
        found = found.crossJoin(F.broadcast(m))
        share = F.when(F.col("_all") < 100, 1.0).otherwise(F.least(F.col("_high") / (0.11 * F.col("_all")), F.lit(1.0)))
    return _back(df, p, out, found.withColumn(out, F.least(share * F.col("_step"), F.lit(1.0))), None)


def fisher_combine(df: DataFrame, p: str, by: list[str]) -> DataFrame:
    """P3. ``by``, chi2, k, pval. The even-degree tail is a finite sum, so it needs no UDF. Its terms go far beyond what a
    double holds where many are combined, so the sum is scaled down as it grows and ``scale`` is the log of that."""
    sums = df.groupBy(*by).agg((-2 * F.sum(F.log(p))).alias("chi2"), F.count(p).alias("k"))
    half = F.col("chi2") / 2

    def add(s: Column, i: Column) -> Column:
        term = s["term"] * half / i
        down = F.when(s["sum"] + term > _LARGE, 1 / _LARGE).otherwise(1.0)
        return F.struct((term * down).alias("term"), ((s["sum"] + term) * down).alias("sum"), (s["scale"] - F.log(down)).alias("scale"))

    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"), F.lit(0.0).alias("scale"))
    terms = F.aggregate(F.sequence(F.lit(1), F.col("k").cast("int") - 1), start, add)
    terms = F.when(F.col("k") > 1, terms).otherwise(start)
    return sums.filter("k > 0").withColumn("_terms", terms).withColumn("pval", F.exp(F.col("_terms.scale") - half) * F.col("_terms.sum")).drop("_terms")


def qq_points(df: DataFrame, p: str = "pval", by: list[str] | None = None) -> DataFrame:
    """P4. ``by``, rank, observed, expected: -log10 of sorted p and of even quantiles (rank-1)/(m-1);
    null for the first, whose quantile is 0."""
    by = by or []
    last = F.col("_before") + F.col("_n")
    parts = _ranked(materialize(df), p, by).withColumn("_last", last).withColumn("_first", F.explode(F.sequence(F.col("_before") + 1, F.col("_last"), F.lit(_TIES))))
    dealt = parts.repartition(F.col("_p"), F.col("_first"))
    rows = dealt.withColumn("_rank", F.explode(F.sequence(F.col("_first"), F.least(F.col("_first") + _TIES - 1, "_last"))))
    at = F.try_divide(F.col("_rank") - 1, F.col("_m") - 1)
    return rows.select(*by, F.col("_rank").alias("rank"), F.when(F.col("_p") > 0, -F.log10("_p")).alias("observed"), F.when(at > 0, -F.log10(at)).alias("expected"))


def threshold_curve(results: DataFrame, p: str, by: list[str], thresholds: list[float]) -> DataFrame:
    """P6. ``by``, threshold, n_below, rate: the share of rows with p below each threshold. A row is
    counted once, at the lowest threshold it falls under; a running sum does the rest."""
    steps = sorted(thresholds)
    place = F.size(F.filter(F.array(*[F.lit(float(t)) for t in steps]), lambda t: t <= F.coalesce(F.col(p), F.lit(float("inf")))))
    counts = results.groupBy(*by, place.alias("_place")).agg(F.count("*").alias("_n"))
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_all"))
    grid = totals.select(*by, "_all", F.posexplode(F.array(*[F.lit(float(t)) for t in steps])).alias("_place", "threshold"))
    filled = grid.join(counts, [*by, "_place"], "left")
    below = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return filled.select(*by, "threshold", below.alias("n_below"), (below / F.col("_all")).alias("rate"))


def power_curve(results: DataFrame, truth: DataFrame, keys: list[str], p: str, by: list[str], thresholds: list[float]) -> DataFrame:
    """P5. ``by``, threshold, recovered, power, false_discoveries (1 - precision): among tests of
    ``truth`` for power, among all tests below the threshold for precision."""
    flagged = results.join(truth.select(*keys).distinct().withColumn("_true", F.lit(True)), keys, "left").withColumn("_true", F.coalesce("_true", F.lit(False)))
    true = threshold_curve(flagged.filter("_true"), p, by, thresholds).withColumnsRenamed({"n_below": "recovered", "rate": "power"})
    every = threshold_curve(flagged, p, by, thresholds).drop("rate")
    return true.join(every, [*by, "threshold"]).withColumn("false_discoveries", 1 - F.try_divide(F.col("recovered"), F.col("n_below"))).drop("n_below")


def roc_auc(curve: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """P6. Trapezoid area of y over x: over thresholds, or over false positive rates."""
    order = Window.partitionBy(*by).orderBy(x, y)
    area = (F.col(x) - F.lag(x).over(order)) * (F.col(y) + F.lag(y).over(order)) / 2
    return curve.select(*by, area.alias("_area")).groupBy(*by).agg(F.coalesce(F.sum("_area"), F.lit(0.0)).alias("auc"))


def tpr_fpr(results: DataFrame, truth: Column, p: str, alpha: float, by: list[str]) -> DataFrame:
    """P7."""
    hit = F.coalesce(F.col(p) < alpha, F.lit(False)).cast("double")
    return results.groupBy(*by).agg(F.avg(F.when(truth, hit)).alias("tpr"), F.avg(F.when(~truth, hit)).alias("fpr"))


def common_keys(results: DataFrame, key: str, table: str) -> DataFrame:
    """P9. Keys that are in every one of the labelled tables."""
    tables = results.agg(F.count_distinct(table).alias("_all"))
    return results.groupBy(key).agg(F.count_distinct(table).alias("_n")).crossJoin(F.broadcast(tables)).filter("_n = _all").select(key)


def concordance_auc(results: DataFrame, references: list[str], k: int, method: str = "method", key: str = "gene_id", p: str = "pval") -> DataFrame:
    """P8. method, auc: mean over the references of the area under the overlap of top lists 1..k, over
    k(k+1)/2, on genes that all methods have. A gene at ranks r and s is in the top i of both from
    i = max(r, s) on, so it adds k + 1 - max(r, s)."""
    shared = results.join(common_keys(results, key, method), key, "left_semi")
    top = shared.withColumn("_rank", F.row_number().over(Window.partitionBy(method).orderBy(F.col(p).asc_nulls_last(), key))).filter(F.col("_rank") <= k)
    refs = top.filter(F.col(method).isin(references)).select(F.col(method).alias("_ref"), key, F.col("_rank").alias("_other"))
    added = k + 1 - F.greatest("_rank", "_other")
    sums = top.join(refs, key).groupBy(method).agg(F.sum(added).alias("_sum"))
    return results.select(method).distinct().join(sums, method, "left").select(method, (F.coalesce("_sum", F.lit(0)) / (len(references) * k * (k + 1) / 2)).alias("auc"))


def concordance_curve(results: DataFrame, reference: str, k: int, method: str = "method", key: str = "gene_id", p: str = "pval") -> DataFrame:
    """P8. method, i, overlap of the top i with the reference's, for i = 1..k."""
    top = results.withColumn("_rank", F.row_number().over(Window.partitionBy(method).orderBy(F.col(p).asc_nulls_last(), key))).filter(F.col("_rank") <= k)
    ref = top.filter(F.col(method) == reference).select(key, F.col("_rank").alias("_other"))
    at = top.join(ref, key).select(method, F.greatest("_rank", "_other").alias("i")).groupBy(method, "i").agg(F.count("*").alias("_n"))
    grid = results.select(method).distinct().select(method, F.explode(F.sequence(F.lit(1), F.lit(k))).alias("i"))
    running = F.sum(F.coalesce("_n", F.lit(0))).over(Window.partitionBy(method).orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return grid.join(at, [method, "i"], "left").select(method, "i", running.alias("overlap"))


def hit_summary(results: DataFrame, a: str, b: str, levels: list[str], hit: Column) -> DataFrame:
    """P10. Counts of hits as a matrix of ``a`` by the listed levels of ``b``."""
    return results.groupBy(a).pivot(b, levels).agg(F.count_if(hit)).fillna(0)


def sign_class(columns: list[str]) -> Column:
    """P10. 'up', 'down', or 'mixed' by the least and greatest of several contrasts."""
    return F.when(F.least(*columns) > 0, "up").when(F.greatest(*columns) < 0, "down").otherwise("mixed")


def enrichment_counts(hits: DataFrame, sets: DataFrame, universe: DataFrame, key: str = "gene_id", name: str = "set") -> DataFrame:
    """P11. set, overlap, set_size, hits, universe: counts within the universe."""
    known = universe.select(key).distinct()
    sets = sets.select(name, key).distinct().join(known, key, "left_semi")
    own = hits.select(key).distinct().join(known, key, "left_semi")
    sizes = known.agg(F.count("*").alias("universe")).crossJoin(own.agg(F.count("*").alias("hits")))
    flagged = sets.join(own.withColumn("_hit", F.lit(1)), key, "left")
    return flagged.groupBy(name).agg(F.count("_hit").alias("overlap"), F.count("*").alias("set_size")).crossJoin(F.broadcast(sizes))


def enrichment_test(hits: DataFrame, sets: DataFrame, universe: DataFrame, key: str = "gene_id", name: str = "set") -> DataFrame:
    """P11. With the hypergeometric upper tail and its fdr."""
    counted = enrichment_counts(hits, sets, universe, key, name)
    return bh_fdr(counted.withColumn("pval", special.hypergeometric_p(F.col("overlap"), F.col("universe"), F.col("set_size"), F.col("hits"))))


def minor_class(genotypes: DataFrame) -> DataFrame:
    """P12. snp, min_count, min_freq of the rarest genotype class."""
    classes = genotypes.groupBy("snp", "dosage").agg(F.count("*").alias("n"))
    return classes.groupBy("snp").agg(F.min("n").alias("min_count"), (F.min("n") / F.sum("n")).alias("min_freq"))


def minor_class_filter(genotypes: DataFrame, min_count: int = 0, min_freq: float = 0.0) -> DataFrame:
    kept = minor_class(genotypes).filter((F.col("min_count") >= min_count) & (F.col("min_freq") >= min_freq))
    return genotypes.join(kept.select("snp"), "snp", "left_semi")


def outer_union(tables: dict[str, DataFrame], label: str) -> DataFrame:
    """U1. Tables one below the other, each with its label."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.withColumn(label, F.lit(n)) for n, t in tables.items()])
