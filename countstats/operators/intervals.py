"""Joins and merges of half-open genomic intervals (chrom, start, end, name).

Positions are put into bins, so that joins are equi-joins and running values cross bins through a
small table of per-bin summaries; no task has to hold a chromosome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import materialize

BIN = 100_000


def _carried(rows: DataFrame, value: Column, how, earlier: bool) -> DataFrame:
    """chrom, _bin, _carried: ``how`` of all ``value`` in the bins before (or after)."""
    each = rows.groupBy("chrom", "_bin").agg(how(value).alias("_v"))
    order = Window.partitionBy("chrom").orderBy("_bin")
    frame = order.rowsBetween(Window.unboundedPreceding, -1) if earlier else order.rowsBetween(1, Window.unboundedFollowing)
    return each.select("chrom", "_bin", how("_v").over(frame).alias("_carried"))


#: A bin with more intervals than this, on both sides together, is cut into smaller ones.
DENSE = 64


def _pieces(df: DataFrame, name: str, width: int) -> DataFrame:
    """A row for each bin that an interval meets, with the part of it in that bin from the bin's start on."""
    low, high = F.col("start"), F.col("end")
    rows = df.select("chrom", F.col("name").alias(f"{name}_name"), low.alias(f"{name}_start"), high.alias(f"{name}_end"), F.explode(F.sequence(F.floor(low / width), F.floor((high - 1) / width))).alias("_bin"))
    first = F.greatest(F.col(f"{name}_start") - F.col("_bin") * width, F.lit(0))
    last = F.least(F.col(f"{name}_end") - F.col("_bin") * width, F.lit(width)) - 1
    return rows.withColumn("_first", first).withColumn("_last", last)


def meeting(a: DataFrame, b: DataFrame, width: int = BIN) -> DataFrame:
    """Pairs of intervals that meet in a step of a bin: a_name, a_start, a_end, b_name, ..., chrom, _bin, _step, _at.

    A bin of more than DENSE intervals is cut into as many steps as make one about as long as its
    intervals' parts are on average: then most of those that meet in a step overlap, however dense they lie.
    """
    left, right = (_pieces(x.filter("start < end"), n, width) for x, n in ((a, "a"), (b, "b")))
    both = left.select("chrom", "_bin", "_first", "_last").union(right.select("chrom", "_bin", "_first", "_last"))
    mean = F.avg(F.col("_last") - F.col("_first") + 1)
    dense = both.groupBy("chrom", "_bin").agg(F.count("*").alias("_n"), mean.alias("_mean")).filter(F.col("_n") > DENSE)
    steps = materialize(dense.select("chrom", "_bin", F.greatest(F.ceil("_mean"), F.lit(1)).alias("_step")))
    at = lambda x: F.floor(x / F.coalesce("_step", F.lit(width))).cast("int")

    def stepped(pieces: DataFrame) -> DataFrame:
        found = pieces.join(steps, ["chrom", "_bin"], "left")
        return found.withColumn("_at", F.explode(F.sequence(at(F.col("_first")), at(F.col("_last"))))).drop("_first", "_last")

    return stepped(left).join(stepped(right).drop("_step"), ["chrom", "_bin", "_at"])


def interval_overlap(a: DataFrame, b: DataFrame, width: int = BIN) -> DataFrame:
    """R1. a_name, b_name, chrom, start, end of the part that both have. Each pair is kept in the one step of the
    one bin in which that part starts, so nothing has to be made distinct. Empty intervals overlap nothing."""
    start, end = F.greatest("a_start", "b_start"), F.least("a_end", "b_end")
    here = start - F.col("_bin") * width
    at = F.floor(here / F.coalesce("_step", F.lit(width))).cast("int")
    kept = meeting(a, b, width).filter((start < end) & (here >= 0) & (here < width) & (at == F.col("_at")))
    return kept.select("a_name", "b_name", "chrom", start.alias("start"), end.alias("end"))


def in_intervals(a: DataFrame, b: DataFrame, width: int = BIN) -> DataFrame:
    """R1. ``a`` with in_peak: does it overlap any of ``b``."""
    found = interval_overlap(a, b, width).select(F.col("a_name").alias("name")).distinct().withColumn("in_peak", F.lit(True))
    return a.join(found, "name", "left").withColumn("in_peak", F.coalesce("in_peak", F.lit(False)))


def interval_window(a: DataFrame, b: DataFrame, reach: int, width: int = BIN) -> DataFrame:
    """R2. Distinct (a_name, b_name) with ``b`` within ``reach`` of ``a``; starts end at 0."""
    wide = a.withColumn("start", F.greatest(F.col("start") - reach, F.lit(0))).withColumn("end", F.col("end") + reach)
    return interval_overlap(wide, b, width).select("a_name", "b_name").distinct()


def interval_closest(a: DataFrame, b: DataFrame, width: int = BIN) -> DataFrame:
    """R3. a_name, b_name, distance to the nearest of ``b``: 0 if they overlap, else the gap and one.
    Of equals the left one, then the larger name. Null where the chromosome has no ``b``."""
    points = b.select("chrom", F.col("start").alias("_at"), F.lit(1).alias("_kind"), F.struct(F.col("end"), F.col("name")).alias("_left"), F.struct(F.col("start").alias("start"), F.col("name")).alias("_right"), F.lit(None).cast("string").alias("a_name"), F.lit(None).cast("long").alias("a_start"))
    asks = a.select("chrom", F.col("end").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(points.schema["_left"].dataType).alias("_left"), F.lit(None).cast(points.schema["_right"].dataType).alias("_right"), F.col("name").cast("string").alias("a_name"), F.col("start").cast("long").alias("a_start"))
    rows = points.unionByName(asks).withColumn("_bin", F.floor(F.col("_at") / width))
    order = Window.partitionBy("chrom", "_bin").orderBy("_at", "_kind")  # at one place the asking end comes first
    rows = rows.withColumn("_l", F.max("_left").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_r", F.min("_right").over(order.rowsBetween(1, Window.unboundedFollowing)))
    before = _carried(rows, F.col("_left"), F.max, True).withColumnRenamed("_carried", "_lc")
    after = _carried(rows, F.col("_right"), F.min, False).withColumnRenamed("_carried", "_rc")
    found = rows.filter("_kind = 0").join(before, ["chrom", "_bin"]).join(after, ["chrom", "_bin"])
    left, right = F.greatest("_l", "_lc"), F.least("_r", "_rc")
    gap_left = F.when(left["end"] > F.col("a_start"), 0).otherwise(F.col("a_start") - left["end"] + 1)
    gap_right = right["start"] - F.col("_at") + 1
    nearer = gap_left.isNotNull() & (gap_right.isNull() | (gap_left <= gap_right))
    return found.select("a_name", F.when(nearer, left["name"]).otherwise(right["name"]).alias("b_name"), F.when(nearer, gap_left).otherwise(gap_right).cast("long").alias("distance"))


def interval_union(intervals: DataFrame, width: int = BIN) -> DataFrame:
    """R4. chrom, start, end, n: overlapping or touching intervals merged into one."""
    rows = intervals.select("chrom", "start", "end").withColumn("_bin", F.floor(F.col("start") / width))
    order = Window.partitionBy("chrom", "_bin").orderBy("start", "end")
    before = _carried(rows, F.col("end"), F.max, True)
    rows = rows.withColumn("_reached", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))).join(before, ["chrom", "_bin"])
    reached = F.greatest("_reached", "_carried")
    rows = rows.withColumn("_new", F.when(reached.isNull() | (F.col("start") > reached), 1).otherwise(0)).drop("_carried", "_reached")
    earlier = _carried(rows, F.col("_new"), F.sum, True)
    rows = rows.withColumn("_in", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).join(earlier, ["chrom", "_bin"])
    merged = rows.withColumn("_island", F.col("_in") + F.coalesce("_carried", F.lit(0))).groupBy("chrom", "_island")
    return merged.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("_island")


def tss_window(genes: DataFrame, reach: int) -> DataFrame:
    """R5. chrom, start, end, name: ``reach`` either side of the start of transcription, floored at 0."""
    tss = F.when(F.col("strand") == "+", F.col("tx_start")).otherwise(F.col("tx_end"))
    return genes.select("chrom", F.greatest(tss - reach, F.lit(0)).alias("start"), (tss + reach).alias("end"), F.col("symbol").alias("name"))


def gene_extent(genes: DataFrame) -> DataFrame:
    """R5. Least start and largest end of a gene's transcripts on a chromosome."""
    return genes.groupBy("symbol", "chrom").agg(F.min("tx_start").alias("start"), F.max("tx_end").alias("end"))


def distance_to_ends(pairs: DataFrame, points: DataFrame, genes: DataFrame, near: int = 100_000) -> DataFrame:
    """R6. name, symbol, to_start, to_end: least distances over a gene's transcripts, with flags."""
    placed = pairs.join(points.select("name", "chrom", "pos"), "name").join(genes, ["symbol", "chrom"])
    out = placed.groupBy("name", "symbol").agg(F.min(F.abs(F.col("pos") - F.col("tx_start"))).alias("to_start"), F.min(F.abs(F.col("pos") - F.col("tx_end"))).alias("to_end"))
    return out.withColumn("near_start", F.col("to_start") < near).withColumn("near_end", F.col("to_end") < near)
