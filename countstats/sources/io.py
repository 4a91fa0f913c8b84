"""Matrix, delimited and interval files in; result tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BED = "chrom string, start bigint, end bigint, name string"


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """file, block, line, value: lines in order of the file's blocks and, in each, of ``line``."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")


def _named_lines(spark: SparkSession, path: str) -> DataFrame:
    """(i, name): the first tab-separated field of each line, numbered from 1. Lines are numbered within
    the files' blocks, whose counts alone meet in one task."""
    lines = _placed(spark, path)
    counts = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("file", "block").orderBy("line")
    numbered = lines.withColumn("place", F.row_number().over(own)).join(starts, ["file", "block"])
    name = F.split_part(F.regexp_replace("value", "\r$", ""), F.lit("\t"), F.lit(1))
    return numbered.select((F.col("start") + F.col("place")).cast("long").alias("i"), name.alias("name"))


def read_mtx(spark: SparkSession, path: str, features: str, barcodes: str) -> DataFrame:
    """Long counts (cell_id, gene_id, x) of a MatrixMarket coordinate file with genes as its rows.

    Comments start with %; the first line after them has the sizes and is left out. Entries may go on
    in further files of a folder; the one that starts with %%MatrixMarket has the sizes. Only that line
    is looked at by itself; entries and names are split over tasks.
    """
    text = _placed(spark, path).filter(F.trim("value") != "")
    head = text.agg(F.min(F.struct((~F.col("value").startswith("%%MatrixMarket")).alias("other"), "file"))["file"].alias("head"))
    rows = text.filter(~F.col("value").startswith("%"))
    first = rows.join(F.broadcast(head), F.col("file") == F.col("head")).agg(F.min(F.struct("file", "block", "line")).alias("s")).select(F.col("s.file").alias("f0"), F.col("s.block").alias("b0"), F.col("s.line").alias("l0"))
    entries = rows.join(F.broadcast(first), (F.col("file") == F.col("f0")) & (F.col("block") == F.col("b0")) & (F.col("line") == F.col("l0")), "left_anti")
    n = F.split(F.trim("value"), r"\s+")
    entries = entries.select(n[0].cast("long").alias("g"), n[1].cast("long").alias("c"), n[2].cast("double").alias("x")).filter("x <> 0")
    genes = _named_lines(spark, features).select(F.col("i").alias("g"), F.col("name").alias("gene_id"))
    cells = _named_lines(spark, barcodes).select(F.col("i").alias("c"), F.col("name").alias("cell_id"))
    return entries.join(genes, "g").join(cells, "c").select("cell_id", "gene_id", "x")


def read_delimited(spark: SparkSession, path: str, sep: str = "\t", header: bool = True, skip: int = 0, schema: str | None = None) -> DataFrame:
    """A delimited table. With ``skip`` the first lines are left out: those of the file's first
    block, found by their order in it; then ``schema`` names the columns and no header is read."""
    if not skip:
        reader = spark.read.option("sep", sep).option("header", header)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    if schema is None:
        raise ValueError("skip needs a schema")
    rows = _placed(spark, path)
    first = rows.orderBy("file", "block", "line").limit(skip).select("line")
    kept = rows.join(F.broadcast(first), "line", "left_anti").filter("value <> ''")
    return kept.select(F.from_csv("value", schema, {"sep": sep}).alias("r")).select("r.*")


def read_bed(spark: SparkSession, path: str, columns: str = BED) -> DataFrame:
    """Tab-separated intervals without a header; .gz files are read as they are."""
    return spark.read.csv(path, sep="\t", schema=columns, comment="#")


def wide_to_long(df: DataFrame, id_cols: list[str], name: str = "gene_id", value: str = "x", drop_zeros: bool = True) -> DataFrame:
    """A matrix-shaped table as triples; zeros and nulls are dropped unless ``drop_zeros`` is off."""
    long = df.unpivot(id_cols, [c for c in df.columns if c not in id_cols], name, value)
    return long.filter(F.col(value) != 0) if drop_zeros else long


def write_result(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
