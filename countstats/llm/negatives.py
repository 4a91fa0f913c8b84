"""Hard negatives: for an anchor and each of its nearest positives, the best rows of other labels in a window of scores.

Every block of candidates is searched by the threshold algorithm: each component has a list of the block's rows in
its order; an anchor reads the lists from the end that its sign prefers and scores what it meets at random access,
until what it has not met cannot matter any more.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import materialize
from .common import tasks_for, whole_vectors

#: Numbers in the vectors of a block of candidates, and of the anchors that a task searches in it, about.
BLOCK_NUMBERS = 1 << 20
#: Places of each list that are read at first; as many again as were read before are read next.
FIRST_READ = 32
_EXACT = float(1 << 53)


class Lists:
    """A block of candidates with a list of its rows for each component, by rising value."""

    def __init__(self, vectors: np.ndarray, codes: np.ndarray):
        self.vectors, self.codes = vectors, codes
        self.order = np.argsort(vectors, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(vectors, self.order, axis=0)
        self.top = np.abs(vectors).max(initial=0)
        self.low, self.high = (f(axis=0) if len(vectors) else np.zeros(vectors.shape[1]) for f in (vectors.min, vectors.max))
        self.accessed = 0  # rows scored at random access so far

    def scores(self, anchor: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Integer scores; as floats only where these are exact. Beyond 2 ** 62 they are an error."""
        self.accessed += len(at)
        rows, most = self.vectors[at], self.top * np.abs(anchor).max(initial=0) * max(1, len(anchor))
        if most < _EXACT:
            return (rows @ anchor).astype(np.int64)
        if most >= 2.0**62 and np.abs(rows @ anchor).max(initial=0) >= 2.0**62:
            raise ValueError("an inner product is beyond 2 ** 62")
        return rows.astype(np.int64) @ anchor.astype(np.int64)


def _floor(value: float) -> int:
    return math.floor(value + abs(value) * 1e-9 + 1e-9)


def threshold_search(lists: Lists, anchor: np.ndarray, wanted: np.ndarray, windows: list[tuple[int | None, int | None]], k: int, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (lowest and highest score, None for any) the ``k`` best rows of the block that are
    ``wanted`` and in it, as (places, scores), ties by the order ``ids``.

    After each read the threshold, the product with the values reached in the lists, is the most that a
    row not met yet can score. Reading ends when that falls strictly below every window's kth score,
    or, of a window with fewer rows, below its lowest score.
    """
    n, dim = lists.vectors.shape
    seen = np.zeros(n, dtype=bool)
    falling = anchor > 0  # such lists are read from their end
    place, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
    reach = _floor(float(np.where(falling, lists.high, lists.low) @ anchor)) if n else 0
    depth, least = 0, min((math.inf if low is None else low for low, _ in windows), default=math.inf)
    if least == math.inf and windows:
        least = -math.inf
    while n and windows and depth < n and reach >= least:
        begin, depth = depth, min(n, max(FIRST_READ, 2 * depth)) if dim else n
        met = np.concatenate([lists.order[begin:depth][:, ~falling].ravel(), lists.order[n - depth : n - begin][:, falling].ravel()]) if dim else np.arange(n)
        fresh = np.zeros(n, dtype=bool)
        fresh[met] = True
        fresh &= ~seen
        seen |= fresh
        new = np.flatnonzero(fresh & wanted)
        place, score = np.concatenate([place, new]), np.concatenate([score, lists.scores(anchor, new)])
        order = np.lexsort((ids[place], -score))
        place, score = place[order], score[order]
        reach = _floor(float(np.where(falling, lists.sorted[n - depth], lists.sorted[depth - 1]) @ anchor))
        least = min(_least(score, w, k) for w in windows)
    found = []
    for window in windows:
        a, b = _span(score, window)
        found.append((place[a : min(b, a + k)], score[a : min(b, a + k)]))
    return found


def _span(score: np.ndarray, window: tuple[int | None, int | None]) -> tuple[int, int]:
    """Where falling ``score`` enters and leaves the window."""
    low, high = window
    return (0 if high is None else int(np.searchsorted(-score, -high)), len(score) if low is None else int(np.searchsorted(-score, -low, side="right")))


def _least(score: np.ndarray, window: tuple[int | None, int | None], k: int) -> float:
    """A row of a lower score has no place in the window's first ``k``."""
    a, b = _span(score, window)
    if b - a >= k:
        return int(score[a + k - 1])
    return -math.inf if window[0] is None else window[0]


def windows_of(positives: list[int], low: int, high: int) -> list[tuple[int, int]]:
    """Scores s with low * p <= 100 * s <= high * p, for each positive score p."""
    return [(-(-low * p // 100), high * p // 100) for p in positives]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


_FOUND = "anchor_row bigint, place int, row bigint, id bigint, score bigint"


def _search(k: int, same: bool, low: int = 0, high: int = 0):
    """Search one block for its anchors: rows of the anchor's label in one window without ends, or rows of
    other labels in a window for each positive score."""

    def run(key: tuple, anchors: pa.Table, block: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
        if len(anchors) and len(block):
            rows, labels = block.column("row").to_numpy(), block.column("label").combine_chunks().dictionary_encode()
            code = {value: i for i, value in enumerate(labels.dictionary.to_pylist())}
            lists = Lists(_matrix(block.column("v")), labels.indices.to_numpy())
            tie = np.empty(len(rows), np.int64)  # place by id, null last, then by row
            tie[pc.sort_indices(block.select(["id", "row"]), [("id", "ascending"), ("row", "ascending")]).to_numpy()] = np.arange(len(rows))
            vectors = _matrix(anchors.column("v"))
            at = {row: i for i, row in enumerate(rows.tolist())} if same else {}
            for i, (own, label, positives) in enumerate(zip(anchors.column("row").to_pylist(), anchors.column("label").to_pylist(), anchors.column("positives").to_pylist())):
                wanted = (lists.codes == code.get(label, -1)) == same
                if own in at:
                    wanted[at[own]] = False
                windows = [(None, None)] if same else windows_of(positives, low, high)
                for place, (found, score) in enumerate(threshold_search(lists, vectors[i], wanted, windows, k, tie)):
                    for column, values in zip(out, (np.full(len(found), own), np.full(len(found), place), found, score)):
                        column.append(values)
        anchor, place, found, score = map(np.concatenate, out)
        found = pa.array(found)
        return pa.table({"anchor_row": anchor, "place": pa.array(place, pa.int32()), "row": block.column("row").take(found), "id": block.column("id").take(found), "score": score})

    return run


def _tiles(anchors: DataFrame, rows: DataFrame, meets: DataFrame, run) -> DataFrame:
    """Each part of the anchors of ``meets`` (anchor_row, block) with its block of candidates."""
    spark = rows.sparkSession
    # A block is read again for each part; parts are so large that most blocks have one.
    room = F.greatest(F.lit(64), F.floor(F.lit(BLOCK_NUMBERS) / F.greatest("dim", F.lit(1))))
    sized = meets.join(anchors.select(F.col("row").alias("anchor_row"), "dim"), "anchor_row").groupBy("block").agg(F.ceil(F.count("*") / F.first(room)).cast("int").alias("parts"))
    sized = materialize(sized)
    left = meets.join(sized, "block").withColumn("part", F.pmod(F.xxhash64("anchor_row"), F.col("parts")).cast("int")).drop("parts").join(anchors.withColumnRenamed("row", "anchor_row"), "anchor_row").withColumnRenamed("anchor_row", "row")
    right = rows.join(sized, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = lambda side: side.repartition(tasks_for(spark), "block", "part").groupBy("block", "part")
    return tiles(left.select("block", "part", "row", "label", "v", "positives")).cogroup(tiles(right.select("block", "part", "id", "row", "label", "v"))).applyInArrow(run, _FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_row", "place").orderBy(F.desc("score"), F.col("id").isNull(), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row for which
    ``is_anchor`` (over ``id``) holds and each of its first ``positives`` other rows of its label, the first
    ``negatives`` rows of other labels whose score is ``low`` to ``high`` percent of the positive's.

    A score is the inner product of floor(scale * x) over components x; higher ones come first, ties by
    the smaller id, null last. Rows with a null label, a null vector or a null or non-finite component
    take no part; a row meets only rows of its dimension. A repeated row is another row, and a
    repeated anchor an anchor of its own. Fewer positives or negatives than asked for are all
    returned; a window above a negative positive score is empty. The search is exact. Labels of many
    rows are split into blocks of bounded size, labels of few rows share some.
    """
    spark = vectors.sparkSession
    clean = whole_vectors(vectors, scale, id_col, vector_col, (F.col(label_col).alias("label"),)).filter("label is not null")
    clean = materialize(clean.withColumn("row", F.monotonically_increasing_id()))
    room = F.greatest(F.lit(64), F.floor(F.lit(BLOCK_NUMBERS) / F.greatest("dim", F.lit(1))))
    counts = materialize(clean.groupBy("dim", "label").agg(F.count("*").alias("n")).withColumn("room", room))
    small = F.col("n") * 2 < F.col("room")
    shared = counts.filter(small).groupBy("dim").agg(F.ceil(F.sum("n") / F.first("room")).alias("shared"))
    dealt = materialize(counts.join(shared, "dim", "left").select("dim", "label", F.when(small, F.pmod(F.xxhash64("label"), F.col("shared"))).alias("mixed"), F.ceil(F.col("n") / F.col("room")).alias("parts")))
    group = F.concat_ws("/", "dim", F.when(F.col("mixed").isNull(), F.concat(F.lit("label "), F.col("label").cast("string"))).otherwise(F.col("mixed").cast("string")))
    # Of a label with blocks of its own every row has a part; labels that share a block are in one part.
    part = F.when(F.col("mixed").isNull(), F.pmod(F.xxhash64("row", F.lit("part")), F.col("parts"))).otherwise(F.lit(0))
    rows = materialize(clean.join(dealt, ["dim", "label"]).withColumn("group", group).withColumn("block", F.concat_ws("/", "group", part)).select("id", "row", "dim", "label", "v", "group", "block", F.col("mixed").isNull().alias("pure")))

    blocks = materialize(rows.select("dim", "group", "block", "pure").distinct())
    anchors = materialize(rows.filter(is_anchor).select("row", "id", "dim", "label", "group", "v"))
    heads = anchors.select(F.col("row").alias("anchor_row"), "dim", "group")
    unknown = anchors.drop("id", "group").withColumn("positives", F.lit(None).cast("array<bigint>"))
    near = _first(_tiles(unknown, rows, heads.join(blocks.select("group", "block"), "group").select("anchor_row", "block"), _search(positives, True)), positives)
    near = materialize(near.select("anchor_row", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))

    known = materialize(near.groupBy(F.col("anchor_row").alias("row")).agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("p")).select("row", F.col("p.positive_score").alias("positives")))
    seeking = materialize(anchors.drop("id").join(known, "row"))
    other = seeking.select(F.col("row").alias("anchor_row"), "dim", F.col("group").alias("own")).join(blocks, "dim").filter(~F.col("pure") | (F.col("own") != F.col("group")))
    found = _first(_tiles(seeking.drop("group"), rows, other.select("anchor_row", "block"), _search(negatives, False, low, high)), negatives)
    found = found.select("anchor_row", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = anchors.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id"))
    return found.join(near, ["anchor_row", "place"]).join(named, "anchor_row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: For the standard parameters, with every seventh label moved on.
ORACLE = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, c.r, c.vec_id, a.label = c.label AS same, CAST(coalesce(list_sum([z[1] * z[2] FOR z IN list_zip(a.e, c.e)]), 0) AS BIGINT) AS score
  FROM v a JOIN v c ON a.r <> c.r AND len(a.e) = len(c.e) WHERE a.vec_id % 100 = 0
), positive AS (
  SELECT ar, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id NULLS LAST, r) AS place FROM scored WHERE same
), negative AS (
  SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.ar, place ORDER BY score DESC, vec_id NULLS LAST, r) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM positive p JOIN scored s USING (ar, anchor_id) WHERE place <= 5 AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT * FROM negative WHERE rank <= 10
"""
