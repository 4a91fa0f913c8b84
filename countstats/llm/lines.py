"""Line dedup: suffix ranks over line-ID sequences by distributed prefix doubling, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import materialize

MIN_LINES = 2
#: A line of so many characters counts as a run on its own.
MIN_CHARS = 100


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _filled(lines: Column) -> Column:
    """Places of the lines that are not blank."""
    return F.filter(F.transform(lines, lambda line, i: F.when(F.trim(line) != "", i)), lambda i: i.isNotNull())


def _ranked(keys: DataFrame, by: list[str]) -> DataFrame:
    """Keys that occur more than once, with an order-preserving ``rank``: partition and row of a range sort."""
    repeated = keys.groupBy(*by).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return materialize(repeated.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id()))


def rank_levels(sequences: DataFrame) -> list[DataFrame]:
    """The suffix ranks of (id, ref, ids): at place k the rows (id, ref, at, rank, long) of all suffixes
    whose first 2 ** k ids occur again, with equal ranks for equal ids and ranks in suffix order.

    Prefix doubling: a suffix's rank by its first h ids and the rank of the suffix h further on give
    its rank by 2 h ids. A suffix whose rank is unique repeats nothing longer and leaves; the doubling
    ends when no rank is left. Rows of one rank are an interval of the suffix array.
    """
    suffixes = sequences.select("id", "ref", F.posexplode("ids").alias("at", "key")).select("id", "ref", "at", "key.*")
    state = materialize(suffixes.join(_ranked(suffixes, ["a", "b"]), ["a", "b"]).select("id", "ref", "at", "rank", "long"))
    levels, h = [], 1
    while not state.isEmpty():
        levels.append(state)
        ahead = Window.partitionBy("id", "ref").orderBy("at").rangeBetween(h, h)
        pairs = materialize(state.withColumn("next", F.first("rank").over(ahead)).filter("next is not null"))
        # Written first, so that the join meets two plain exchanges and a hot rank can be split.
        ranks = _ranked(pairs.select(F.col("rank").alias("a"), F.col("next").alias("b")), ["a", "b"])
        ranks = ranks.select(F.col("a").alias("rank"), F.col("b").alias("next"), F.col("rank").alias("new"))
        state = materialize(pairs.join(ranks, ["rank", "next"]).select("id", "ref", "at", F.col("new").alias("rank"), "long"))
        h *= 2
    return levels


def _order(at: str = "at") -> Column:
    """Earlier means a smaller id (null last), or a place further up in the text."""
    return F.struct(F.col("id").isNull().alias("z"), "id", "ref", F.col(at).alias("at"))


def later_copies(levels: list[DataFrame], runs: DataFrame) -> DataFrame:
    """Those of ``runs`` (id, ref, start, end) whose ids have all occurred, in a row, earlier.

    The interval of suffixes that begin with a run of n ids, 2 ** k <= n < 2 ** (k + 1), are those with
    its rank at level k that have, n - 2 ** k further on, the rank of the run's last 2 ** k ids: its
    longest common prefix is n at least. The run is a later copy unless it is the interval's first.
    """
    every = reduce(DataFrame.union, [level.select(F.lit(k).alias("k"), "id", "ref", "at", "rank") for k, level in enumerate(levels)])
    last = every.select(F.col("k").alias("k2"), F.col("id").alias("id2"), F.col("ref").alias("ref2"), F.col("at").alias("at2"), F.col("rank").alias("tail"))
    meets = lambda at: (F.col("k") == F.col("k2")) & F.col("id").eqNullSafe(F.col("id2")) & (F.col("ref") == F.col("ref2")) & (at == F.col("at2"))
    gone = ("k2", "id2", "ref2", "at2")
    sized = runs.withColumn("k", F.floor(F.log2(F.col("end") - F.col("start") + 0.5)).cast("int"))
    sized = sized.withColumn("shift", (F.col("end") - F.col("start") - F.expr("shiftleft(1, k)")).cast("int"))
    headed = sized.join(last.withColumnRenamed("tail", "head"), meets(F.col("start"))).drop(*gone)
    keyed = materialize(headed.join(last, meets(F.col("start") + F.col("shift"))).drop(*gone))

    wanted = materialize(keyed.select("k", F.col("head").alias("rank"), "shift").distinct())
    copies = every.join(wanted, ["k", "rank"]).join(last, meets(F.col("at") + F.col("shift")))
    first = materialize(copies.groupBy("k", F.col("rank").alias("head"), "shift", "tail").agg(F.min(_order()).alias("first")))
    return keyed.join(first, ["k", "head", "shift", "tail"]).filter(_order("start") != F.col("first")).select("id", "ref", "start", "end")


def _windows(levels: list[DataFrame], length: int) -> DataFrame:
    """(id, ref, start, end) of every run of ``length`` ids that may occur again."""
    k = length.bit_length() - 1
    if k >= len(levels):
        return levels[0].limit(0).select("id", "ref", F.col("at").alias("start"), F.col("at").alias("end"))
    return levels[k].select("id", "ref", F.col("at").alias("start"), (F.col("at") + length).alias("end"))


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, ref, runs): the lines, as (start, end) by filled line, of later copies; for documents that have any.

    A run counts from ``min_lines`` filled lines on, and a single line from ``min_chars`` characters on. Every
    maximal run that occurred earlier is a later copy and goes: its parts of ``min_lines`` lines (two at least) occurred
    earlier too, so these are looked up, and those that share lines are joined. Where A, B and B, C
    occurred earlier, A, B, C go together. Earlier means a smaller doc_id (null last), or a place
    further up in the text.
    """
    if min_lines < 1 or min_chars < 1:
        raise ValueError("min_lines and min_chars must be at least 1")
    lines = _lines(F.col("text"))
    key = lambda x: F.struct(F.xxhash64(x).alias("a"), F.hash(x, F.lit(1)).alias("b"), (F.char_length(x) >= min_chars).alias("long"))
    ids = F.transform(F.filter(lines, lambda x: F.trim(x) != ""), key)
    sequences = docs.filter("text is not null").select(F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("ref"), ids.alias("ids"))
    sequences = sequences.groupBy("id", "ref").agg(F.first("ids").alias("ids"))  # rows of equal id and text are one document
    levels = rank_levels(materialize(sequences))
    if not levels:
        return sequences.limit(0).select("id", "ref", F.lit(None).cast("array<struct<start:int,end:int>>").alias("runs"))

    single = levels[0].filter("long").select("id", "ref", F.col("at").alias("start"), (F.col("at") + 1).alias("end"))
    windows = _windows(levels, min_lines) if min_lines > 1 else _windows(levels, 1).union(_windows(levels, 2))
    pieces = later_copies(levels, windows.union(single).distinct())
    own = Window.partitionBy("id", "ref").orderBy("start", "end")
    reached = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    joined = pieces.withColumn("new", F.coalesce(F.col("start") >= reached, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    runs = joined.groupBy("id", "ref", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy("id", "ref").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"))


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, keep: list[str] | None = None, min_chars: int = MIN_CHARS) -> DataFrame:
    """``keep`` (all columns by default) with ``text`` rid of later copies of repeated line runs, and
    n_lines and n_deleted.

    The runs of ``repeated_runs`` are deleted, each with the blank lines inside it; blank lines count
    for nothing else. Null and empty texts stay as they are. Rows of equal doc_id and text count as
    one document and keep equal texts. doc_id may have any type that has an order. Existing columns
    n_lines, n_deleted are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_lines", "n_deleted")]
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("doc_id", "text").alias("_ref"), F.col("text").alias("_text"))
    joined = rows.join(repeated_runs(docs, min_lines, min_chars), F.col("_id").eqNullSafe(F.col("id")) & (F.col("_ref") == F.col("ref")), "left")
    joined = joined.withColumn("_lines", _lines(F.col("_text"))).withColumn("_filled", F.when(F.col("runs").isNotNull(), _filled(F.col("_lines"))))
    # The runs' complement: from the end of each run to the start of the next.
    cut = F.transform("runs", lambda r: F.struct(F.get("_filled", r["start"]).alias("start"), (F.get("_filled", r["end"] - 1) + 1).alias("end")))
    joined = joined.withColumn("_cut", cut)
    starts = F.concat(F.array(F.lit(0)), F.transform("_cut", lambda c: c["end"]))
    ends = F.concat(F.transform("_cut", lambda c: c["start"]), F.array(F.size("_lines")))
    pieces = F.zip_with(starts, ends, lambda a, b: F.slice("_lines", a + 1, b - a))
    text = F.when(F.col("runs").isNull(), F.col("_text")).otherwise(F.array_join(F.flatten(pieces), "\n"))
    deleted = F.coalesce(F.aggregate("_cut", F.lit(0), lambda n, c: n + c["end"] - c["start"]), F.lit(0)).cast("long")
    n_lines = F.when(F.col("_text").isNull(), 0).otherwise(F.size("_lines")).cast("long")
    out = joined.select("_row", text.alias("_text"), n_lines.alias("n_lines"), deleted.alias("n_deleted"))
    if "text" in keep:
        return out.select(F.col("_row").withField("text", F.col("_text")).alias("_row"), "n_lines", "n_deleted").select("_row.*", "n_lines", "n_deleted")
    return out.select("_row.*", F.col("_text").alias("text"), "n_lines", "n_deleted")


#: For the standard limits: pairs of neighbouring filled lines and long single lines that occurred before
#: go; where they share lines they are one run, which goes with the blank lines inside it.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents
), filled AS (
  SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM lines) WHERE trim(line) <> ''
), pieces AS (
  SELECT a.doc_id, a.p AS s, a.p + 2 AS e, row_number() OVER (PARTITION BY a.line, b.line ORDER BY a.doc_id, a.p) AS nth
  FROM filled a JOIN filled b ON b.doc_id = a.doc_id AND b.p = a.p + 1
  UNION ALL
  SELECT doc_id, p, p + 1, row_number() OVER (PARTITION BY line ORDER BY doc_id, p) FROM filled WHERE length(line) >= 100
), marked AS (
  SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh
  FROM pieces WHERE nth > 1
), runs AS (
  SELECT doc_id, min(s) AS s, max(e) AS e
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM marked) GROUP BY doc_id, k
), copies AS (
  SELECT r.doc_id, a.i AS i, b.i AS j FROM runs r JOIN filled a ON a.doc_id = r.doc_id AND a.p = r.s JOIN filled b ON b.doc_id = r.doc_id AND b.p = r.e - 1
), deleted AS (
  SELECT doc_id, list(DISTINCT k) AS gone FROM (SELECT doc_id, unnest(range(i, j + 1)) AS k FROM copies) GROUP BY doc_id
)
SELECT doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string([l[k] FOR k IN range(1, len(l) + 1) IF NOT list_contains(gone, k)], chr(10)) END AS text,
       CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_deleted
FROM lines LEFT JOIN deleted USING (doc_id)
"""
