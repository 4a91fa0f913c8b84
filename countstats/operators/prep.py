"""Filters, quality control, normalisation, labels, sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import running_before


def filter_cells(counts: DataFrame, cells: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """F1. Cells for which ``predicate`` holds, and the counts of these."""
    kept = cells.filter(predicate)
    return counts.join(kept.select("cell_id"), "cell_id", "left_semi"), kept


def filter_genes(counts: DataFrame, genes: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    kept = genes.filter(predicate)
    return counts.join(kept.select("gene_id"), "gene_id", "left_semi"), kept


def cell_qc(counts: DataFrame, cells: DataFrame, flagged: Column) -> DataFrame:
    """F2. cell_id, total, n_genes, pct_flagged (of genes for which ``flagged`` holds); zeros for an
    empty cell, whose percentage is null."""
    x = F.col("x")
    sums = counts.groupBy("cell_id").agg(F.sum(x).alias("total"), F.count_if(x > 0).alias("n_genes"), F.sum(F.when(flagged, x).otherwise(0)).alias("_part"))
    joined = cells.select("cell_id").join(sums, "cell_id", "left").fillna(0, ["total", "n_genes", "_part"])
    return joined.withColumn("pct_flagged", F.try_divide(100.0 * F.col("_part"), F.col("total"))).drop("_part")


def min_genes_per_cell(counts: DataFrame, k: int) -> DataFrame:
    """F3. Counts of cells with at least ``k`` detected genes."""
    return _with_at_least(counts, "cell_id", k)


def min_cells_per_gene(counts: DataFrame, k: int) -> DataFrame:
    return _with_at_least(counts, "gene_id", k)


def _with_at_least(counts: DataFrame, key: str, k: int) -> DataFrame:
    kept = counts.filter("x > 0").groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") >= k)
    return counts.join(kept.select(key), key, "left_semi")


def drop_gene_prefix(df: DataFrame, prefix: str, col: str = "gene_id") -> DataFrame:
    """F4."""
    return df.filter(~F.col(col).startswith(prefix))


def drop_gene_containing(df: DataFrame, part: str, col: str = "gene_id") -> DataFrame:
    return df.filter(~F.col(col).contains(part))


def normalize_total(counts: DataFrame, target: float) -> DataFrame:
    """F5. x scaled so that each cell's sum is ``target``. Sums join back: one cell's rows never
    have to fit in a window."""
    totals = counts.groupBy("cell_id").agg(F.sum("x").alias("_total"))
    return counts.join(totals, "cell_id").withColumn("x", F.try_divide(F.col("x") * target, F.col("_total"))).drop("_total")


def log1p(df: DataFrame, col: str = "x") -> DataFrame:
    """F6."""
    return df.withColumn(col, F.log1p(col))


def undo_log_normalize(df: DataFrame, n_counts: Column, col: str = "x") -> DataFrame:
    return df.withColumn(col, n_counts * F.expm1(col))


def assign_capture_rate(cells: DataFrame, rate: float | dict, batch: str | None = None) -> DataFrame:
    """F7. ``q``: one rate, or that of the row's ``batch`` (null where it has none)."""
    if not isinstance(rate, dict):
        return cells.withColumn("q", F.lit(float(rate)))
    return cells.withColumn("q", reduce(lambda rest, kv: F.when(F.col(batch) == kv[0], F.lit(float(kv[1]))).otherwise(rest), rate.items(), F.lit(None).cast("double")))


def relabel(df: DataFrame, col: str, mapping: dict, default: str | None = None, out: str | None = None) -> DataFrame:
    """F8. Mapped values, ``default`` (or the value as it is) for others."""
    pairs = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    return df.withColumn(out or col, F.coalesce(pairs[F.col(col)], F.lit(default) if default is not None else F.col(col)))


def assign_class(df: DataFrame, rules: list[tuple[Column, str]], default: str | None = None, out: str = "class") -> DataFrame:
    """F8. The value of the first rule that holds."""
    return df.withColumn(out, reduce(lambda rest, rule: F.when(rule[0], rule[1]).otherwise(rest), reversed(rules), F.lit(default)))


def split_label(col: str, sep: str, i: int) -> Column:
    """F9. Part ``i`` from 0; null past the last."""
    parts = F.split(F.col(col), "\\Q" + sep + "\\E")
    return F.get(parts, F.lit(i))


def join_label(cols: list[str], sep: str) -> Column:
    return F.concat_ws(sep, *cols)


def parse_locus(df: DataFrame, col: str) -> DataFrame:
    """F10. 'chr:pos' as chrom and the half-open interval [pos - 1, pos)."""
    pos = F.split_part(col, F.lit(":"), F.lit(2)).cast("long")
    return df.withColumns({"chrom": F.split_part(col, F.lit(":"), F.lit(1)), "start": pos - 1, "end": pos})


def top_label_per_cell(tags: DataFrame, min_value: float = 5, max_ratio: float = 0.3) -> DataFrame:
    """F11. cell_id, tag, n, second, ratio: the largest tag (ties to the smaller name) of cells that
    have one above ``min_value``, where the second is less than ``max_ratio`` of it."""
    # Two largest by aggregation: max of all, then max of all but that one.
    order = F.struct(F.col("n"), F.col("tag"))
    ranked = tags.withColumn("_place", F.row_number().over(Window.partitionBy("cell_id").orderBy(F.desc("n"), "tag"))).filter("_place <= 2")
    best = ranked.groupBy("cell_id").agg(F.max(F.when(F.col("_place") == 1, order)).alias("_best"), F.max(F.when(F.col("_place") == 2, F.col("n"))).alias("second"))
    best = best.select("cell_id", F.col("_best.tag").alias("tag"), F.col("_best.n").alias("n"), F.coalesce("second", F.lit(0)).alias("second"))
    return best.filter(F.col("n") > min_value).withColumn("ratio", F.col("second") / F.col("n")).filter(F.col("ratio") < max_ratio)


def clr_normalize(counts: DataFrame, n_features: int, margin: str = "cell_id") -> DataFrame:
    """F12. ln(1 + x / exp(mean of ln(1 + x))), the mean over ``n_features`` values of the margin,
    zeros among them."""
    means = counts.groupBy(margin).agg((F.sum(F.log1p("x")) / n_features).alias("_mean"))
    return counts.join(means, margin).withColumn("x", F.log1p(F.col("x") / F.exp("_mean"))).drop("_mean")


def explode_list(df: DataFrame, col: str, sep: str, out: str) -> DataFrame:
    """F13. One row for each item."""
    return df.withColumn(out, F.explode(F.split(F.col(col), "\\Q" + sep + "\\E")))


def regroup_list(df: DataFrame, keys: list[str], col: str, sep: str, out: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(col)), sep).alias(out))


def valid_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """F14. Rows finite in all of ``cols``."""
    return df.filter(reduce(Column.__and__, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in cols]))


def fill_missing(df: DataFrame, value: float, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(float(value))) for c in cols})


def replace_inf(df: DataFrame, value: float, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.abs(c) == float("inf"), F.lit(float(value))).otherwise(F.col(c)) for c in cols})


def dedupe(df: DataFrame, keys: list[str], order_by: list[Column]) -> DataFrame:
    """F15. The first row of each key in a stated order."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))).filter("_place = 1").drop("_place")


def hash_order(key: str, seed: int) -> Column:
    """A reproducible pseudorandom order by integer key, of products modulo a prime and a shift, so that
    any engine can repeat it. The first factor is that prime's golden section: near keys part at once."""
    prime = F.lit(2147483647)
    spread = F.pmod(F.pmod(F.col(key).cast("long"), prime) * F.lit(1327217885) + F.lit(11 * seed + 12345), prime)
    return F.pmod(spread.bitwiseXOR(F.shiftright(spread, 15)) * F.lit(48271 + 2 * seed), prime)


def stratified_sample(df: DataFrame, group: list[str], n: int, key: str, seed: int = 0) -> DataFrame:
    """F16. Exactly min(n, size) rows of each group, without replacement, by a hash of ``key``."""
    order = Window.partitionBy(*group).orderBy(hash_order(key, seed), key)
    return df.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= n).drop("_place")


def shuffle(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    return df.orderBy(hash_order(key, seed), key)


def permute_within(df: DataFrame, key: list[str], value: str, order: str, seed: int = 0) -> DataFrame:
    """F17. ``value`` shuffled inside each key: the row at place i of ``order`` gets the value at place
    i of the hashed order."""
    placed = running_before(df, key, [order], {"_place": F.lit(1)})
    values = running_before(df.select(*key, order, F.col(value).alias("_value"), hash_order(order, seed).alias("_hash")), key, ["_hash", order], {"_place": F.lit(1)})
    values = values.select(*[F.col(c).alias(f"_by_{c}") for c in key], F.col("_place").alias("_place_2"), "_value")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in key], F.col("_place") == F.col("_place_2"))
    return placed.join(values, same).withColumn(value, F.col("_value")).select(*df.columns)
