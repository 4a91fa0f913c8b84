"""Size factors, groups, bins, strata, and the compression that the bootstrap works on.

Tables: ``counts`` (cell_id, gene_id, x; no zeros) and ``cells`` (cell_id, labels, q, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import quantiles
from ..functions.lineage import materialize

#: Listed pairs that every task may hold.
LISTED = 200_000
#: Entries of one group and bin that a task counts together, about.
BIN_ROWS = 500_000


def validate(counts: DataFrame, cells: DataFrame) -> dict[str, int]:
    """Check q < 1, x >= 0 and unique keys; the number of cells without counts comes back."""
    worst = cells.agg(F.max("q").alias("q"), F.count("*").alias("n"), F.count_distinct("cell_id").alias("d")).first()
    least = counts.groupBy("cell_id", "gene_id").agg(F.count("*").alias("n"), F.min("x").alias("x")).agg(F.max("n").alias("n"), F.min("x").alias("x")).first()
    if worst["q"] is not None and worst["q"] >= 1:
        raise ValueError("capture rates must be below 1")
    if worst["n"] != worst["d"] or (least["n"] or 1) > 1:
        raise ValueError("cells and (cell, gene) pairs must be unique")
    if least["x"] is not None and least["x"] < 0:
        raise ValueError("counts must not be negative")
    return {"empty_cells": cells.join(counts, "cell_id", "left_anti").count()}


def total_size_factor(counts: DataFrame, cells: DataFrame, absolute: bool = False) -> DataFrame:
    """S1. ``cells`` with size_factor: the sum of x, 0 for an empty cell; 1 if ``absolute``."""
    if absolute:
        return cells.withColumn("size_factor", F.lit(1.0))
    totals = counts.groupBy("cell_id").agg(F.sum("x").cast("double").alias("_total"))
    return cells.join(totals, "cell_id", "left").withColumn("size_factor", F.coalesce("_total", F.lit(0.0))).drop("_total")


def trimmed_size_factor(counts: DataFrame, cells: DataFrame, genes: DataFrame, shrinkage: float = 0.5) -> DataFrame:
    """S4. ``cells`` with size_factor from the sum over ``genes`` (gene_id), raised by its
    ``shrinkage`` quantile, divided by the raised sums' median, times the median of all totals.
    Both statistics are over all of ``cells``. Where that median is 0, as without genes, size factors are null."""
    flagged = counts.join(genes.select("gene_id", F.lit(1).alias("_in")), "gene_id", "left")
    sums = flagged.groupBy("cell_id").agg(F.sum("x").cast("double").alias("_total"), F.sum(F.when(F.col("_in") == 1, F.col("x"))).cast("double").alias("_part"))
    joined = materialize(cells.join(sums, "cell_id", "left").fillna(0.0, ["_total", "_part"]))
    both = joined.select(F.explode(F.array(F.struct(F.lit(True).alias("part"), F.col("_part").alias("v")), F.struct(F.lit(False).alias("part"), F.col("_total").alias("v")))).alias("s")).select("s.*")
    found = quantiles(both, ["part"], "v", [shrinkage, 0.5], ["shift", "mid"])
    of = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
    stats = found.agg(of(False, "mid").alias("_depth"), of(True, "shift").alias("_shift"), of(True, "mid").alias("_mid"))
    # Raising all sums alike raises their median by as much.
    shift = F.col("_shift") if shrinkage > 0 else F.lit(0.0)
    factor = F.try_divide(F.col("_part") + shift, F.col("_mid") + shift) * F.col("_depth")
    return joined.crossJoin(F.broadcast(stats)).withColumn("size_factor", factor).drop("_total", "_part", "_depth", "_shift", "_mid")


def _escaped(label: Column, delimiter: str) -> Column:
    return F.coalesce(F.replace(F.replace(label, F.lit("%"), F.lit("%p")), F.lit(delimiter), F.lit("%d")), F.lit("%n"))


def _unescaped(label: Column, delimiter: str) -> Column:
    return F.when(label != "%n", F.replace(F.replace(label, F.lit("%d"), F.lit(delimiter)), F.lit("%p"), F.lit("%")))


def create_groups(cells: DataFrame, label_columns: list[str], delimiter: str = "^", min_cell_count: int = 10) -> tuple[DataFrame, DataFrame]:
    """S5. ``cells`` with ``grp``, and groups (grp, labels, n_cells, q). Groups of fewer cells than
    ``min_cell_count`` are left out of both; q is the mean of the group's cells. Names of groups are
    labels between delimiters; a delimiter or % in a label is written as %d or %p and a null label as
    %n, so that labels that differ never share a name."""
    if not delimiter or set(delimiter) & set("%dpn"):
        raise ValueError("the delimiter must not be empty or have any of % d p n")
    name = F.concat_ws(delimiter, F.lit("sg"), *[_escaped(F.col(c).cast("string"), delimiter) for c in label_columns])
    named = cells.withColumn("grp", name)
    groups = named.groupBy("grp", *label_columns).agg(F.count("*").alias("n_cells"), F.avg("q").alias("q")).filter(F.col("n_cells") >= min_cell_count)
    return named.join(groups.select("grp"), "grp", "left_semi"), groups


def split_group_names(groups: DataFrame, label_columns: list[str], delimiter: str = "^") -> DataFrame:
    """S6. Labels out of stored names: a column is numeric if all its values but nulls are."""
    parts = groups.select("grp", *[_unescaped(F.split_part("grp", F.lit(delimiter), F.lit(i + 2)), delimiter).alias(c) for i, c in enumerate(label_columns)])
    numeric = parts.agg(*[F.every(F.when(F.col(c).isNotNull(), F.col(c).try_cast("double").isNotNull())).alias(c) for c in label_columns]).first()
    return parts.select("grp", *[F.col(c).cast("double").alias(c) if numeric[c] else F.col(c) for c in label_columns])


def bin_size_factor(cells: DataFrame, num_bins: int = 30) -> DataFrame:
    """S7. ``cells`` with sf_bin: the mean size factor of the cell's bin, of ``num_bins`` even ones
    over all cells; the largest size factor stays as it is."""
    ends = cells.agg(F.min("size_factor").alias("_low"), F.max("size_factor").alias("_high"))
    width = F.col("_high") - F.col("_low")
    index = F.when(width > 0, F.least(F.floor((F.col("size_factor") - F.col("_low")) / width * num_bins), F.lit(num_bins - 1))).otherwise(0)
    placed = cells.crossJoin(F.broadcast(ends)).withColumn("_bin", index)
    means = placed.groupBy("_bin").agg(F.avg("size_factor").alias("_mean"))  # num_bins rows
    binned = placed.join(F.broadcast(means), "_bin")
    return binned.withColumn("sf_bin", F.when(F.col("size_factor") == F.col("_high"), F.col("size_factor")).otherwise(F.col("_mean"))).drop("_bin", "_mean", "_low", "_high")


def compress(counts: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """S8. (grp, gene_id, sf_bin, x, n): cells of equal value and bin, zeros included, for the
    (grp, gene_id) pairs of ``genes``. Zeros are what a bin's cells lack in counts."""
    keyed = cells.select("cell_id", "grp", "sf_bin")
    seen = counts.filter("x <> 0").join(keyed, "cell_id").join(genes.select("grp", "gene_id"), ["grp", "gene_id"], "left_semi")
    filled = seen.groupBy("grp", "gene_id", "sf_bin", "x").agg(F.count("*").alias("n"))
    bins = keyed.groupBy("grp", "sf_bin").agg(F.count("*").alias("all"))
    used = filled.groupBy("grp", "gene_id", "sf_bin").agg(F.sum("n").alias("used"))
    zeros = genes.select("grp", "gene_id").join(bins, "grp").join(used, ["grp", "gene_id", "sf_bin"], "left")
    left = (F.col("all") - F.coalesce("used", F.lit(0))).alias("n")
    zeros = zeros.select("grp", "gene_id", "sf_bin", F.lit(0).cast(counts.schema["x"].dataType).alias("x"), left).filter("n > 0")
    return filled.unionByName(zeros)


def joint_counts(counts: DataFrame, cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """(grp, gene_1, gene_2, sf_bin, x1, x2, n): cells that have both genes of a listed pair.

    Up to LISTED pairs go to all tasks and each cell becomes one row, whose entries meet in place: what is
    made of a cell is shuffled only when it has been counted, and cells of one group and bin come to the same tasks, where
    counts are few. For more pairs, or few among many genes, either the entries of each cell meet and listed pairs are kept, or each
    entry meets its partners; what makes fewer rows by an exact count is done. Only joint entries, summed up, go on from there.
    """
    listed = materialize(pairs.select("gene_1", "gene_2").distinct())
    involved = listed.select(F.col("gene_1").alias("gene_id")).union(listed.select("gene_2")).distinct()
    only = counts.filter("x <> 0").join(involved, "gene_id", "left_semi").join(cells.select("cell_id", "grp", "sf_bin"), "cell_id")
    only = materialize(only.select("cell_id", "grp", "sf_bin", "gene_id", "x"))
    in_cells = only.groupBy("cell_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0))).first()[0]
    partners = listed.groupBy(F.col("gene_1").alias("gene_id")).agg(F.count("*").alias("p"))
    in_pairs = only.join(partners, "gene_id").agg(F.coalesce(F.sum("p"), F.lit(0))).first()[0]
    first = only.select("cell_id", "grp", "sf_bin", F.col("gene_id").alias("gene_1"), F.col("x").alias("x1"))
    second = only.select("cell_id", F.col("gene_id").alias("gene_2"), F.col("x").alias("x2"))
    if in_cells <= 4 * in_pairs and listed.count() <= LISTED:
        largest = only.groupBy("grp", "sf_bin").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        place = ["grp", "sf_bin", "_part"]
        tasks = max(only.sparkSession.sparkContext.defaultParallelism, int(only.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        dealt = only.withColumn("_part", F.pmod(F.xxhash64("cell_id"), F.lit(-(-largest // BIN_ROWS) or 1))).repartition(tasks, *place)
        whole = dealt.groupBy(*place, "cell_id").agg(F.collect_list(F.struct("gene_id", "x")).alias("_all"))
        one = whole.select("grp", "sf_bin", "_all", F.explode("_all").alias("_1"))
        two = one.select("grp", "sf_bin", F.col("_1.gene_id").alias("gene_1"), F.col("_1.x").alias("x1"), F.explode("_all").alias("_2"))
        met = two.select("grp", "sf_bin", "gene_1", "x1", F.col("_2.gene_id").alias("gene_2"), F.col("_2.x").alias("x2")).join(F.broadcast(listed), ["gene_1", "gene_2"])
    elif in_cells <= in_pairs:
        met = first.join(second, "cell_id").join(listed, ["gene_1", "gene_2"])
    else:
        met = first.join(listed, "gene_1").join(second, ["cell_id", "gene_2"])
    return met.groupBy("grp", "gene_1", "gene_2", "sf_bin", "x1", "x2").agg(F.count("*").alias("n"))


def compress_pairs(counts: DataFrame, cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """S9. (grp, gene_1, gene_2, sf_bin, x1, x2, n) in the same way for pairs of genes: joint entries are
    counted, and cells that have one gene or none are what is left of its own counts, and of the bin."""
    keys, kind = ["grp", "gene_1", "gene_2", "sf_bin"], counts.schema["x"].dataType
    listed = pairs.select("gene_1", "gene_2").distinct()
    genes = listed.select(F.col("gene_1").alias("gene_id")).union(listed.select("gene_2")).distinct()
    keyed = cells.select("cell_id", "grp", "sf_bin")
    joint = materialize(joint_counts(counts, cells, listed))
    single = counts.filter("x <> 0").join(genes, "gene_id", "left_semi").join(keyed, "cell_id").groupBy("grp", "gene_id", "sf_bin", "x").agg(F.count("*").alias("n"))
    single = materialize(single)

    def alone(i: int) -> DataFrame:
        """Cells that have gene i and not the other."""
        own = listed.join(single.withColumnsRenamed({"gene_id": f"gene_{i}", "x": f"x{i}", "n": "all"}), f"gene_{i}")
        both = joint.groupBy(*keys, f"x{i}").agg(F.sum("n").alias("both"))
        left = own.join(both, [*keys, f"x{i}"], "left").withColumn("n", F.col("all") - F.coalesce("both", F.lit(0))).filter("n > 0")
        return left.select(*keys, *[F.col(f"x{i}") if i == j else F.lit(0).cast(kind).alias(f"x{j}") for j in (1, 2)], "n")

    filled = materialize(joint.select(*keys, "x1", "x2", "n").unionByName(alone(1)).unionByName(alone(2)))
    bins = keyed.groupBy("grp", "sf_bin").agg(F.count("*").alias("all"))
    used = filled.groupBy(*keys).agg(F.sum("n").alias("used"))
    zeros = bins.crossJoin(listed).join(used, keys, "left")  # as many rows as the result needs
    zeros = zeros.select(*keys, F.lit(0).cast(kind).alias("x1"), F.lit(0).cast(kind).alias("x2"), (F.col("all") - F.coalesce("used", F.lit(0))).alias("n"))
    return filled.unionByName(zeros.filter("n > 0"))


def with_weights(compressed: DataFrame, draws: int, seed: int = 5) -> DataFrame:
    """``compressed`` rows with ``w``, a weight for each draw by a rule that any engine can repeat: n more or
    less a remainder of a product of the rows' numbers, never below 0. For tests of what follows the draws;
    see ``testing.ht_1d``. ``n`` and the values must be whole numbers."""
    values = [c for c in ("x", "x1", "x2") if c in compressed.columns]
    mixed = sum(((i + 2) * F.col(c) for i, c in enumerate(values)), F.col("n") * 7 + seed)
    weight = lambda d: F.greatest(F.col("n") + (mixed * (2 * d + 3) + d * d) % 5 - 2, F.lit(0))
    return compressed.withColumn("w", F.transform(F.sequence(F.lit(1).cast("long"), F.lit(draws).cast("long")), lambda d: weight(d).cast("double")))


def quantile_strata(df: DataFrame, col: str, k: int, out: str = "stratum", median: bool = False) -> DataFrame:
    """S10. Equal-frequency strata 0..k-1 by quantile edges. If edges repeat, two strata: is ``col``
    not 0. With ``median`` also each stratum's median as ``<out>_median``."""
    names = [f"_e{i}" for i in range(1, k)]
    edges = quantiles(df, [], col, [i / k for i in range(1, k)], names).select(F.array(*names).alias("_e"))
    value = F.col(col)
    repeated = F.size(F.array_distinct("_e")) < k - 1
    place = F.size(F.filter("_e", lambda e: e < value))
    ranked = df.crossJoin(F.broadcast(edges)).withColumn(out, F.when(repeated, (value != 0).cast("int")).otherwise(place)).drop("_e")
    if not median:
        return ranked
    ranked = materialize(ranked)
    return ranked.join(F.broadcast(quantiles(ranked, [out], col, [0.5], [f"{out}_median"])), out)  # k rows


def equal_width_strata(df: DataFrame, col: str, k: int, out: str = "stratum") -> DataFrame:
    """S11. Bins 1..k of an even grid from 0 to the largest value, which falls into bin k."""
    top = df.agg(F.max(col).alias("_top"))
    index = F.least(F.floor(F.col(col) / F.col("_top") * k) + 1, F.lit(k))
    return df.crossJoin(F.broadcast(top)).withColumn(out, index.cast("int")).drop("_top")
