"""Exact top-k by inner product: cover trees over blocks of queries and of data, searched together.

The upper levels of both trees are tables: cells around pivots hold blocks, and pairs of cells, then of
blocks, fall away by their covering radii. The lower levels are a cover tree in each block; a pair of
blocks that is left is searched by a task. Pairs are met best first, in rounds: what a round finds
tightens the bounds of the next.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import materialize
from .common import tasks_for, whole_vectors

#: Rows of a block of data and of queries, about: what one task holds of either.
DATA_BLOCK = 8192
QUERY_BLOCK = 4096
#: Most cells of the data and of the queries; so many times so many pairs of cells are looked at.
DATA_CELLS = 4096
QUERY_CELLS = 256
#: Rows drawn for first lower bounds of the kth scores.
SAMPLE = 1024
#: Points of a leaf of data and of queries: a group of queries is bound by the worst of them.
LEAF = 64
QUERY_LEAF = 8
#: Children of a node at most. A level that needs more centers is cut around so many far apart ones.
CHILDREN = 32
#: Nodes of so many points at most are multiplied whole if none of their children's pairs falls away.
SMALL = 512
#: Blocks of data that one task meets with its block of queries, and the growth of a round.
AT_ONCE = 8
GROWTH = 4
_EXACT = float(1 << 53)
_HIGHEST = 2.0**62


@dataclass
class CoverTree:
    """Points in tree order with nodes as arrays; a node's points are ``start:end``, its first child
    ``child`` (0: a leaf) and the following ``children`` nodes."""

    points: np.ndarray
    order: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    start: np.ndarray
    end: np.ndarray
    child: np.ndarray
    children: np.ndarray


def _gaps(points: np.ndarray, center: np.ndarray) -> np.ndarray:
    gap = points - center
    return np.sqrt((gap * gap).sum(axis=1))


def _nets(points: np.ndarray, left: np.ndarray, center: int, reach: float, most: int) -> list[tuple[int, np.ndarray]]:
    """Centers farther than ``reach`` apart, each with the points of ``left`` within ``reach`` that no
    earlier one has; empty if it takes more than ``most``."""
    nets, pivot = [], center
    while len(left):
        if len(nets) == most:
            return []
        near = _gaps(points[left], points[pivot]) <= reach
        nets.append((pivot, left[near]))
        left = left[~near]
        pivot = left[0] if len(left) else -1
    return nets


def _spread(points: np.ndarray, left: np.ndarray, center: int, most: int) -> list[tuple[int, np.ndarray]]:
    """``most`` centers, each the point farthest from those before it, and the points nearest to each."""
    pivots, nearest, which = [center], _gaps(points[left], points[center]), np.zeros(len(left), dtype=np.int64)
    while len(pivots) < most and nearest.max() > 0:
        pivots.append(left[int(nearest.argmax())])
        gap = _gaps(points[left], points[pivots[-1]])
        which[gap < nearest] = len(pivots) - 1
        nearest = np.minimum(gap, nearest)
    return [(p, left[which == i]) for i, p in enumerate(pivots) if (which == i).any()]


def build_tree(points: np.ndarray, leaf: int = LEAF) -> CoverTree:
    """A node whose points lie within r of its center has children that cover them within half of
    the next power of two at most, each center being farther than that from those before it. Where
    that takes very many children, as with evenly scattered points, the node is cut around a few
    centers instead, whose radii are what they turn out to be. Leaves have ``leaf`` points or equal ones."""
    order = np.arange(len(points))
    rows: list[list] = []

    def node(start: int, end: int, center: int) -> int:
        rows.append([center, float(_gaps(points[order[start:end]], points[center]).max()), start, end, 0, 0])
        return len(rows) - 1

    todo = [node(0, len(points), 0)]
    while todo:
        at = todo.pop(0)
        center, radius, start, end, _, _ = rows[at]
        if end - start <= leaf or radius == 0:
            continue
        own = order[start:end].copy()
        most = max(2, min(CHILDREN, 2 * len(own) // leaf))
        nets = _nets(points, own, center, 2.0 ** (math.ceil(math.log2(radius)) - 1), most)
        if len(nets) < 2:
            nets = _spread(points, own, center, most)
        if len(nets) < 2:
            continue
        order[start:end] = np.concatenate([members for _, members in nets])
        rows[at][4], rows[at][5] = len(rows), len(nets)
        for pivot, members in nets:
            todo.append(node(start, start + len(members), pivot))
            start += len(members)
    table = np.array(rows, dtype=float)
    center, start, end, child, children = (table[:, i].astype(np.int64) for i in (0, 2, 3, 4, 5))
    return CoverTree(points[order], order, points[center], table[:, 1], start, end, child, children)


class _Best:
    """The k best (score, id, row) of each query so far; ``least`` is a score that the kth has at least."""

    def __init__(self, k: int, least: np.ndarray, rows: np.ndarray):
        self.k, self.least, self.rows = k, least, rows
        n = len(rows)
        self.found = [(np.zeros(0, np.int64),) * 3 for _ in range(n)]

    def offer(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        for i in np.flatnonzero(scores.max(axis=1) >= self.least[queries]):
            q, of_query = queries[i], scores[i]
            least = self.least[q]
            if len(of_query) > self.k + 1:  # the query's own row may be among them
                least = max(least, np.partition(of_query, len(of_query) - self.k - 1)[len(of_query) - self.k - 1])
            take = np.flatnonzero((of_query >= least) & (rows != self.rows[q]))
            if not len(take):
                continue
            s, i, r = (np.concatenate(x) for x in zip(self.found[q], (of_query[take].astype(np.int64), ids[take], rows[take])))
            best = np.lexsort((r, i, -s))[: self.k]
            self.found[q] = (s[best], i[best], r[best])
            if len(best) == self.k:
                self.least[q] = max(self.least[q], s[best[-1]])


def search(queries: CoverTree, data: CoverTree, best: _Best, ids: np.ndarray, rows: np.ndarray) -> int:
    """Offer every query all data but pairs of nodes that cannot hold one of its k best; the number
    of inner products of query and data that this took.

    No inner product of points within rq and rd of two centers exceeds the centers' product plus
    rq|cd| + rd|cq| + rq*rd. A pair below the worst kth score of its queries is left out. ``ids``,
    ``rows`` are in the data tree's order; ``best`` is in the query tree's.
    """
    q_norm, d_norm = (np.sqrt((t.center * t.center).sum(axis=1)) for t in (queries, data))
    made = 0

    def bound(q: int, d: np.ndarray) -> np.ndarray:
        exact = data.center[d] @ queries.center[q]
        reach = queries.radius[q] * d_norm[d] + data.radius[d] * q_norm[q] + queries.radius[q] * data.radius[d]
        return exact + reach + 1e-9 * (np.abs(exact) + reach) + 1e-9

    def children(tree: CoverTree, at: int) -> np.ndarray:
        return np.arange(tree.child[at], tree.child[at] + tree.children[at])

    todo = [(0, 0)]
    while todo:
        q, d = todo.pop()
        own = slice(queries.start[q], queries.end[q])
        worst = best.least[own].min()
        if bound(q, np.array([d]))[0] < worst:
            continue
        q_leaf, d_leaf = queries.children[q] == 0, data.children[d] == 0
        if (q_leaf and d_leaf) or _hopeless(queries, data, q, d, worst, bound, children):
            part = slice(data.start[d], data.end[d])
            for first in range(own.start, own.stop, 256):
                some = slice(first, min(first + 256, own.stop))
                made += (some.stop - some.start) * (part.stop - part.start)
                best.offer(np.arange(some.start, some.stop), _products(queries.points[some], data.points[part], best.rows[some], rows[part]), ids[part], rows[part])
        elif d_leaf or (not q_leaf and queries.radius[q] > data.radius[d]):
            todo += [(int(c), d) for c in children(queries, q)]
        else:
            below = children(data, d)
            todo += [(q, int(c)) for c in below[np.argsort(bound(q, below), kind="stable")]]  # the most promising is popped first
    return made


def _hopeless(queries: CoverTree, data: CoverTree, q: int, d: int, worst: float, bound, children) -> bool:
    """If no pair of children of two small nodes falls away, their points are multiplied at once: what
    lies deeper is smaller than a product of matrices is worth."""
    if worst == -np.inf or max(queries.end[q] - queries.start[q], data.end[d] - data.start[d]) > SMALL:
        return False
    for_q = children(queries, q) if queries.children[q] else np.array([q])
    for_d = children(data, d) if data.children[d] else np.array([d])
    return all((bound(int(c), for_d) >= worst).all() for c in for_q)


def _products(a: np.ndarray, b: np.ndarray, a_rows: np.ndarray, b_rows: np.ndarray) -> np.ndarray:
    """Integer inner products; as floats only where these are exact. Beyond 2 ** 62 they are an error,
    but for a row with itself."""
    about = a @ b.T
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1]) < _EXACT:
        return about
    if (np.abs(about) * (a_rows[:, None] != b_rows[None, :])).max(initial=0) >= _HIGHEST:
        raise ValueError("an inner product is beyond 2 ** 62")
    return a.astype(np.int64) @ b.astype(np.int64).T


def _nearest(pivots: dict[int, np.ndarray]):
    @F.pandas_udf(T.IntegerType())
    def cell(v: pd.Series, dim: pd.Series) -> pd.Series:
        out = np.zeros(len(v), dtype=np.int32)
        for d, own in pivots.items():
            mask = (dim == d).to_numpy()
            if mask.any() and d:
                x = np.array(v[mask].to_list(), dtype=float)
                out[mask] = np.argmin((own * own).sum(axis=1) - 2 * x @ own.T, axis=1)
        return pd.Series(out)

    return cell


def _blocked(rows: DataFrame, pivots: dict[int, np.ndarray], size: int) -> DataFrame:
    """``rows`` with ``cell`` and ``block``: rows of one dimension near one pivot, split by a hash to
    about ``size``."""
    placed = rows.withColumn("cell", F.concat_ws("/", "dim", _nearest(pivots)("v", "dim")))
    parts = materialize(placed.groupBy("cell").agg(F.ceil(F.count("*") / size).alias("parts")))
    return placed.join(parts, "cell").withColumn("block", F.concat_ws("/", "cell", F.pmod(F.xxhash64("row"), F.col("parts"))))


def _narrow(tree: CoverTree) -> CoverTree:
    """With points as short as they go: trees travel to the tasks that meet them."""
    top = np.abs(tree.points).max(initial=0)
    kind = next((t for t in (np.int8, np.int16, np.int32) if top <= np.iinfo(t).max), np.float64)
    return replace(tree, points=tree.points.astype(kind))


def _wide(tree: CoverTree) -> CoverTree:
    return replace(tree, points=tree.points.astype(float))


#: Stands for a null id in a block, and comes after all others.
_NO_ID = (1 << 63) - 1
_BLOCK = "block string, cell string, dim int, n int, tree binary, center array<double>, radius double, least double"


def _trees(rows: DataFrame, sampled: dict[int, tuple[np.ndarray, np.ndarray]] | None, k: int) -> DataFrame:
    """A row for each block: its cover tree with ids and rows in tree order. For blocks of queries also
    a score that the kth of each has at least, from the sampled data; ``least`` is the worst of these."""

    def grow(key: tuple, table: pa.Table) -> pa.Table:
        frame, ids = table.drop_columns("id").to_pandas(), table.column("id").fill_null(_NO_ID).to_numpy()
        points = np.array(frame["v"].to_list(), dtype=float).reshape(len(frame), -1)
        tree, row = build_tree(points, LEAF if sampled is None else QUERY_LEAF), frame["row"].to_numpy()
        least = np.full(len(frame), -np.inf)
        known, known_rows = (sampled or {}).get(int(frame["dim"][0]), (np.zeros((0, points.shape[1])), np.zeros(0, np.int64)))
        if len(known) > k:
            scores = _products(points, known, row, known_rows).astype(float)
            scores[row[:, None] == known_rows[None, :]] = -np.inf
            least = np.partition(scores, len(known) - k, axis=1)[:, len(known) - k]
        blob = pickle.dumps((_narrow(tree), ids[tree.order], row[tree.order], least[tree.order]))
        return pa.table({"block": [key[0].as_py()], "cell": [frame["cell"][0]], "dim": pa.array([frame["dim"][0]], pa.int32()), "n": pa.array([len(frame)], pa.int32()), "tree": [blob], "center": [tree.center[0]], "radius": [tree.radius[0]], "least": [float(least.min())]})

    return materialize(rows.select("block", "cell", "dim", "id", "row", "v").groupBy("block").applyInArrow(grow, _BLOCK))


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _highest(q: str, d: str) -> Column:
    """No inner product of points of two balls is higher; columns <q>_center, <q>_radius and so on."""
    exact, qr, dr = _dot(f"{q}_center", f"{d}_center"), F.col(f"{q}_radius"), F.col(f"{d}_radius")
    reach = qr * F.sqrt(_dot(f"{d}_center", f"{d}_center")) + dr * F.sqrt(_dot(f"{q}_center", f"{q}_center")) + qr * dr
    return exact + reach + (F.abs(exact) + reach) * 1e-9 + 1e-9


def _balls(blocks: DataFrame, name: str, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(<name>_cell, dim, center, radius, least) of every cell: a ball around its pivot, or around the
    center of one of its blocks, that holds the balls of all its blocks."""
    spark = blocks.sparkSession
    own = [(f"{d}/{i}", p.tolist()) for d, m in pivots.items() for i, p in enumerate(m)]
    pivot = spark.createDataFrame(own, "cell string, pivot array<double>")
    one = blocks.groupBy("cell").agg(F.min_by("center", "block").alias("any"))
    middle = one.join(pivot, "cell", "left").select("cell", F.coalesce("pivot", "any").alias("middle"))
    gap = F.sqrt(F.aggregate(F.zip_with("center", "middle", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    cells = blocks.join(materialize(middle), "cell").groupBy("cell", "dim").agg(F.first("middle").alias(f"{name}_center"), F.max((gap + F.col("radius")) * (1 + 1e-12)).alias(f"{name}_radius"), F.min("least").alias(f"{name}_least"))
    return materialize(cells.withColumnRenamed("cell", f"{name}_cell"))


def _pairs(queries: DataFrame, data: DataFrame, q_pivots: dict[int, np.ndarray], d_pivots: dict[int, np.ndarray]) -> DataFrame:
    """(q, d, high) of blocks that may have to meet, by way of cells that may. Cells are bounded in
    number; blocks only meet within pairs of cells."""
    q_cells, d_cells = _balls(queries, "q", q_pivots), _balls(data, "d", d_pivots)
    cells = materialize(q_cells.join(d_cells, "dim").filter(_highest("q", "d") >= F.col("q_least")).select("q_cell", "d_cell"))
    heads = lambda b, name: b.select(F.col("block").alias(name), F.col("cell").alias(f"{name}_cell"), F.col("center").alias(f"{name}_center"), F.col("radius").alias(f"{name}_radius"), F.col("least").alias(f"{name}_least"))
    met = cells.join(heads(queries, "q"), "q_cell").repartition(tasks_for(queries.sparkSession), "d_cell", "q").join(heads(data, "d"), "d_cell")
    return materialize(met.withColumn("high", _highest("q", "d")).filter(F.col("high") >= F.col("q_least")).select("q", "d", "high"))


_FOUND = "query_row bigint, query_id bigint, q string, row bigint, vec_id bigint, score bigint"


def _meet(k: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """One block of queries and up to AT_ONCE of data, the most promising first."""
        rows = sorted(table.to_pylist(), key=lambda r: (r["data"] is not None, -(r["high"] or 0.0), r["d"] or ""))
        q_tree, q_ids, q_rows, least = pickle.loads(rows[0]["tree"])
        known = dict(zip(rows[0]["rows"] or [], rows[0]["scores"] or []))
        least = np.maximum(least, [known.get(r, -np.inf) for r in q_rows.tolist()])
        q_tree, best = _wide(q_tree), _Best(k, least, q_rows)
        for r in rows[1:]:
            d_tree, d_ids, d_rows, _ = pickle.loads(r["data"])
            search(q_tree, _wide(d_tree), best, d_ids, d_rows)
        counts = [len(s) for s, _, _ in best.found]
        score, vec, row = (np.concatenate(x) for x in zip(*best.found))
        return pa.table({"query_row": np.repeat(q_rows, counts), "query_id": np.repeat(q_ids, counts), "q": pa.array([key[0].as_py()] * len(score), pa.string()), "row": row, "vec_id": vec, "score": score})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which ``is_query`` (over ``id``) holds, the
    ``k`` other rows with the highest inner product of floor(scale * x), ties to the smaller id, null last.

    A query row's candidates are all rows of its dimension but itself; a repeated row is another
    row, and a repeated query row is a query of its own. A row of null id is a candidate (so the
    largest long can't be an id). Rows whose vector is null or holds a null or non-finite component
    take no part; an empty table gives no rows. With fewer than ``k`` candidates all are returned. Rows near the same of a bounded number of pivots are put into blocks of bounded size,
    also if a third of all rows are one vector, and each block becomes a cover tree once. Pairs of
    blocks whose bound is below the queries' kth scores fall away: first against those in a bounded
    sample, then, from round to round, against those found. Products up to 2 ** 62 are exact, beyond
    they are an error.
    """
    spark = vectors.sparkSession
    rows = materialize(whole_vectors(vectors, scale, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()))
    total = rows.count()
    drawn = rows.orderBy(F.xxhash64("id", "row")).limit(max(SAMPLE, min(DATA_CELLS, total // data_block))).toPandas()
    by_dim = {int(d): part for d, part in drawn.groupby("dim")}
    matrix = {d: np.array(part["v"].to_list(), dtype=float).reshape(len(part), -1) for d, part in by_dim.items()}
    sampled = {d: (matrix[d][:SAMPLE], part["row"].to_numpy()[:SAMPLE]) for d, part in by_dim.items()}
    d_pivots, q_pivots = ({d: m[: max(1, min(most, math.ceil(total / size)))] for d, m in matrix.items()} for most, size in ((DATA_CELLS, data_block), (QUERY_CELLS, query_block * 20)))

    data = _trees(_blocked(rows, d_pivots, data_block), None, k)
    queries = _trees(_blocked(rows.filter(is_query), q_pivots, query_block), sampled, k)
    pairs = _pairs(queries, data, q_pivots, d_pivots)
    turn = Window.partitionBy("q").orderBy(F.desc("high"), "d")
    pairs = materialize(pairs.withColumn("place", F.row_number().over(turn) - 1))
    last = pairs.agg(F.max("place")).first()[0]

    best = spark.createDataFrame([], _FOUND)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    begin, end = 0, AT_ONCE
    while last is not None and begin <= last:
        kth = best.groupBy("q", "query_row").agg(F.min("score").alias("score"), F.count("*").alias("n")).filter(F.col("n") >= k)
        known = materialize(kth.groupBy("q").agg(F.collect_list("query_row").alias("rows"), F.collect_list(F.col("score").cast("double")).alias("scores")))
        state = queries.select(F.col("block").alias("q"), "tree", "n", "least").join(known, "q", "left")
        worst = F.when(F.size("scores") >= F.col("n"), F.greatest("least", F.array_min("scores"))).otherwise(F.col("least"))
        state = materialize(state.withColumn("worst", worst))
        now = pairs.filter((F.col("place") >= begin) & (F.col("place") < end)).join(state.select("q", "worst"), "q").filter(F.col("high") >= F.col("worst"))
        now = materialize(now.select("q", "d", "high", F.floor((F.col("place") - begin) / AT_ONCE).alias("part")))
        trees = data.select(F.col("block").alias("d"), F.col("tree").alias("data"))
        right = now.join(trees, "d").select("q", "part", F.lit(None).cast("binary").alias("tree"), F.lit(None).cast("array<bigint>").alias("rows"), F.lit(None).cast("array<double>").alias("scores"), "d", "high", "data")
        left = now.select("q", "part").distinct().join(state, "q").select("q", "part", "tree", "rows", "scores", F.lit(None).cast("string").alias("d"), F.lit(None).cast("double").alias("high"), F.lit(None).cast("binary").alias("data"))
        tiles = left.union(right).repartition(tasks_for(spark), "q", "part")
        found = tiles.groupBy("q", "part").applyInArrow(_meet(k), _FOUND)
        best = materialize(best.union(found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank"))
        begin, end = end, end + (end - begin) * GROWTH
    return best.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", F.nullif("vec_id", F.lit(_NO_ID)).alias("vec_id"), "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.r AS qr, q.vec_id AS query_id, c.vec_id, c.r, CAST(list_sum([a[1] * a[2] FOR a IN list_zip(q.e, c.e)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id NULLS LAST, r) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
