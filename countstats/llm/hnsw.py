"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph for each shard.

Distinct vectors are dealt to shards by a hash. A task builds a shard's graph, whose layers are flat arrays of
neighbours; blocks of queries then meet every shard, and the shards' results are merged.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import materialize
from .common import clean_vectors, tasks_for

#: Distinct vectors of a shard, about, and distinct queries of a block.
SHARD_ROWS = 8192
QUERY_BLOCK = 2048
#: Links of a point in the upper layers; twice as many in the lowest.
LINKS = 16
#: Candidates that a search keeps while the graph is built and while it is asked.
EF_BUILD = 96
EF_SEARCH = 128
#: Points that enter the graph, or queries that walk it, in step.
_TOGETHER = 128


@dataclass
class Graph:
    """``layers[l]`` holds the neighbours, -1 for none, of points ``0 .. len(layers[l]) - 1``: the points of a
    layer are the first ones, so a flat array needs no index. Every search begins at point 0."""

    points: np.ndarray
    layers: list[np.ndarray]


def lifted(points: np.ndarray) -> np.ndarray:
    """``points`` by their greatest length, with one more component that makes all of them length 1: of such
    points the nearest is the one of the largest inner product with a query whose last component is 0."""
    top = np.abs(points).max(initial=0) or 1.0
    scaled = points / top
    scaled /= np.sqrt((scaled * scaled).sum(axis=1).max(initial=0)) or 1.0
    rest = np.sqrt(np.maximum(0.0, 1.0 - (scaled * scaled).sum(axis=1)))
    return np.column_stack([scaled, rest]).astype(np.float32)


def walk(points: np.ndarray, layer: np.ndarray, queries: np.ndarray, entries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query its ``ef`` best points (-1 for none) and their products, best first: from its entry on,
    the best point whose neighbours were not looked at yet is followed, until none is left among the best.
    Queries take their steps together."""
    n, every = len(queries), np.arange(len(queries))
    best, score = np.full((n, ef), -1), np.full((n, ef), -np.inf, np.float32)
    best[:, 0], score[:, 0] = entries, np.einsum("qd,qd->q", points[entries], queries)
    fresh = np.zeros((n, ef), dtype=bool)
    fresh[:, 0] = True
    seen = np.zeros((n, len(layer)), dtype=bool)
    seen[every, entries] = True
    while True:
        lead = np.where(fresh, score, -np.inf)
        at = lead.argmax(axis=1)
        own = np.flatnonzero(lead[every, at] > -np.inf)
        if not len(own):
            break
        at = at[own]
        fresh[own, at] = False
        near = layer[best[own, at]]
        new = (near >= 0) & ~seen[own[:, None], near]
        seen[own[:, None], np.where(near >= 0, near, best[own, at][:, None])] = True
        products = np.where(new, np.einsum("qld,qd->ql", points[near], queries[own]), -np.inf)
        all_score = np.concatenate([score[own], products], axis=1)
        top = np.argpartition(-all_score, ef - 1, axis=1)[:, :ef]
        score[own] = np.take_along_axis(all_score, top, axis=1)
        best[own] = np.take_along_axis(np.concatenate([best[own], np.where(new, near, -1)], axis=1), top, axis=1)
        fresh[own] = np.take_along_axis(np.concatenate([fresh[own], new], axis=1), top, axis=1)
    order = np.argsort(-score, axis=1, kind="stable")
    return np.take_along_axis(best, order, axis=1), np.take_along_axis(score, order, axis=1)


def _diverse(points: np.ndarray, owners: np.ndarray, found: np.ndarray, score: np.ndarray, most: int, must: np.ndarray | None = None) -> np.ndarray:
    """Of each owner's candidates, best first, those that ``must`` be taken and those that are nearer to the
    owner than to any taken before them, ``most`` at most; places that stay free go to the best of the others."""
    real = (found >= 0) & (found != owners[:, None])
    must = real & must if must is not None else np.zeros(found.shape, dtype=bool)
    own = points[found]
    between = own @ own.transpose(0, 2, 1)
    taken, room = np.zeros(found.shape, dtype=bool), most - must.sum(axis=1)
    for j in range(found.shape[1]):
        blocked = (taken[:, :j] & (between[:, j, :j] > score[:, j, None])).any(axis=1)
        free = real[:, j] & ~must[:, j] & ~blocked & (room > 0)
        taken[:, j] = free | must[:, j]
        room -= free
    rank = np.where(taken, 0, np.where(real, 1, 2))
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    links = np.where(np.take_along_axis(rank, order, axis=1) < 2, np.take_along_axis(found, order, axis=1), -1)
    return np.pad(links, ((0, 0), (0, max(0, most - links.shape[1]))), constant_values=-1)


def _best_first(points: np.ndarray, owners: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates of each owner sorted by product, none twice."""
    found = np.sort(found, axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    score = np.where(found >= 0, np.einsum("qld,qd->ql", points[found], points[owners]), -np.inf)
    order = np.argsort(-score, axis=1, kind="stable")
    return np.take_along_axis(found, order, axis=1), np.take_along_axis(score, order, axis=1)


def _link_back(points: np.ndarray, layer: np.ndarray, new: np.ndarray, parent: np.ndarray) -> None:
    """Give the neighbours of the points ``new``, and their parents, a link to them; one with too many keeps
    those to its children and a diverse choice of the others."""
    to, source = np.column_stack([layer[new], parent[new]]).ravel(), np.repeat(new, layer.shape[1] + 1)
    to, source = to[to >= 0], source[to >= 0]
    if not len(to):
        return
    order = np.argsort(to, kind="stable")
    owners, start, counts = np.unique(to[order], return_index=True, return_counts=True)
    for size in np.unique(np.ceil(np.log2(counts)).astype(int)):  # owners of about as many new links together
        some = np.flatnonzero(np.ceil(np.log2(counts)).astype(int) == size)
        width = int(counts[some].max())
        place = start[some][:, None] + np.arange(width)
        incoming = np.where(np.arange(width) < counts[some][:, None], source[order][np.minimum(place, len(order) - 1)], -1)
        for at in range(0, len(some), 512):
            part = slice(at, at + 512)
            own = owners[some][part]
            found, score = _best_first(points, own, np.concatenate([layer[own], incoming[part]], axis=1))
            few = (found >= 0).sum(axis=1) <= layer.shape[1]
            layer[own[few]] = found[few][:, : layer.shape[1]]
            if not few.all():
                layer[own[~few]] = _diverse(points, own[~few], found[~few], score[~few], layer.shape[1], parent[found[~few]] == own[~few, None])


def build(points: np.ndarray, links: int = LINKS, ef: int = EF_BUILD) -> Graph:
    """A graph over ``points`` (see ``lifted``), whose order must say nothing about them. Each layer has
    about a ``links``-th of the points of the one below it, from the top on, and is built from the
    top: points enter a few at a time, search what is there, and link to a diverse choice of what they
    find and of each other. A point's parent, the best of what it finds that has few children, always
    keeps its link to it, so that every point can be reached.
    """
    sizes = [len(points)]
    while sizes[-1] > links:
        sizes.append(math.ceil(sizes[-1] / links))
    layers: list[np.ndarray] = []
    for depth, size in enumerate(reversed(sizes)):
        layer = np.full((size, links if depth < len(sizes) - 1 else 2 * links), -1, dtype=np.int32)
        above = len(layers[0]) if layers else 0
        begin, parent, children = 0, np.full(size, -1), np.zeros(size, dtype=np.int64)
        while begin < size:
            end = min(size, begin + max(1, min(_TOGETHER, begin)))
            new = np.arange(begin, end)
            mates = np.broadcast_to(new, (len(new), len(new)))
            if begin:
                entries = descend(points, layers, points[new]) if begin >= above else np.zeros(len(new), np.int64)
                found = walk(points, layer, points[new], entries, ef)[0]
                for i, own in zip(new.tolist(), found):
                    own = own[own >= 0]
                    parent[i] = own[int((children[own] < links // 2).argmax())]
                    children[parent[i]] += 1
                mates = np.concatenate([found, mates], axis=1)
            found, score = _best_first(points, new, np.where(mates == new[:, None], -1, mates))
            layer[new, :links] = _diverse(points, new, found[:, :ef], score[:, :ef], links)
            _link_back(points, layer, new, parent)
            begin = end
        layers.insert(0, layer)
    return Graph(points, layers)


def descend(points: np.ndarray, layers: list[np.ndarray], queries: np.ndarray) -> np.ndarray:
    """The point at which each query ends that follows the best neighbour through ``layers``, from the last to the first."""
    at = np.zeros(len(queries), np.int64)
    for layer in reversed(layers):
        at = walk(points, layer, queries, at, 1)[0][:, 0]
    return at


def ask(graph: Graph, queries: np.ndarray, ef: int) -> np.ndarray:
    """``ef`` points of the graph (-1 for none) for each of ``queries``, given in the graph's own scale or any other."""
    out = []
    for start in range(0, len(queries), _TOGETHER):
        some = queries[start : start + _TOGETHER]
        some = some / np.maximum(np.abs(some).max(axis=1, keepdims=True), np.finfo(float).tiny)
        some = np.column_stack([some, np.zeros(len(some))]).astype(np.float32)
        out.append(walk(graph.points, graph.layers[0], some, descend(graph.points, graph.layers[1:], some), ef)[0])
    return np.concatenate(out)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, summed component by component, so that equal vectors score alike everywhere."""
    out = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
    for d in range(a.shape[-1]):
        out += a[..., d] * b[..., d]
    return out


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


_INDEX = "dim int, shard bigint, n int, points binary, links array<int>, sizes array<int>, starts array<int>, ids array<bigint>, rows array<bigint>"
_FOUND = "node bigint, row bigint, vec_id bigint, score double"


def _distinct(rows: DataFrame, most: int) -> DataFrame:
    """(node, dim, v, members): a row for each distinct vector, with the ``most`` first of the rows that have it.
    Later ones can be in no result; they fall away in each task before rows are sorted by vector."""
    first = Window.partitionBy("dim", "v").orderBy(F.col("id").isNull(), "id", "row")
    kept = rows.withColumn("_place", F.row_number().over(first)).filter(F.col("_place") <= most)
    member = F.struct(F.col("id").isNull().alias("z"), F.col("id").alias("vec_id"), "row")
    nodes = kept.groupBy("dim", "v").agg(F.sort_array(F.collect_list(member)).alias("members"))
    return materialize(nodes.select(F.monotonically_increasing_id().alias("node"), "dim", "v", F.transform("members", lambda m: F.struct(m["vec_id"], m["row"])).alias("members")))


def build_index(nodes: DataFrame, shard_rows: int = SHARD_ROWS, links: int = LINKS, ef: int = EF_BUILD) -> DataFrame:
    """A row for each shard of ``nodes``: its vectors, the layers' flat neighbour arrays one after the other
    with their sizes, and the members of each vector from ``starts`` on, all in the graph's order."""

    def grow(table: pa.Table) -> pa.Table:
        table = table.sort_by([("deal", "ascending"), ("node", "ascending")])
        points = _matrix(table.column("v"))
        graph = build(lifted(points), links, ef)
        flat = np.concatenate([layer.ravel() for layer in graph.layers])
        members = pa.concat_arrays(table.column("members").chunks)
        listed = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        one = {c: table.column(c)[:1] for c in ("dim", "shard")} | {"n": pa.array([len(points)], pa.int32()), "points": [points.tobytes()]}
        return pa.table(one | {"links": listed(pa.array(flat)), "sizes": listed(pa.array([len(layer) for layer in graph.layers], pa.int32())), "starts": listed(members.offsets), "ids": listed(members.values.field("vec_id")), "rows": listed(members.values.field("row"))})

    parts = materialize(nodes.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).alias("parts")))
    dealt = nodes.join(parts, "dim").withColumn("deal", F.xxhash64("v")).withColumn("shard", F.pmod("deal", "parts"))
    dealt = dealt.select("node", "dim", "shard", "deal", "v", "members").repartition(tasks_for(nodes.sparkSession), "dim", "shard")
    return materialize(dealt.groupBy("dim", "shard").applyInArrow(grow, _INDEX))


def _search(k: int, ef: int, links: int):
    def run(key: tuple, blocks: pa.Table, index: pa.Table) -> pa.Table:
        """One block of distinct queries in one shard: the rows of its k best vectors at least, by exact score."""
        empty = pa.table({"node": pa.array([], pa.int64()), "row": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not len(blocks) or not len(index):
            return empty
        shard = {c: index.column(c)[0] for c in index.column_names}
        n, dim = shard["n"].as_py(), shard["dim"].as_py()
        points = np.frombuffer(shard["points"].as_buffer(), dtype=float).reshape(n, dim)
        flat, layers, at = shard["links"].values.to_numpy(), [], 0
        for depth, size in enumerate(shard["sizes"].as_py()):
            width = 2 * links if depth == 0 else links
            layers.append(flat[at : at + size * width].reshape(size, width))
            at += size * width
        graph, queries, nodes = Graph(lifted(points), layers), _matrix(blocks.column("v")), blocks.column("node").to_numpy()
        starts, ids, rows = shard["starts"].values.to_numpy(), shard["ids"].values, shard["rows"].values.to_numpy()
        picked_query, picked, picked_score = [], [], []
        found = ask(graph, queries, ef)
        for start in range(0, len(queries), _TOGETHER):
            part = found[start : start + _TOGETHER]
            score = np.where(part >= 0, products(queries[start : start + len(part), None, :], points[part]), -np.inf)
            order = np.argsort(-score, axis=1, kind="stable")
            kth = np.take_along_axis(score, order, axis=1)[:, min(k, part.shape[1]) - 1]
            q, j = np.nonzero((part >= 0) & (score >= kth[:, None]))  # ties of the kth as well
            picked_query.append(nodes[start + q])
            picked.append(part[q, j])
            picked_score.append(score[q, j])
        node, at, score = map(np.concatenate, (picked_query, picked, picked_score))
        many = starts[at + 1] - starts[at]
        place = np.repeat(starts[at], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return pa.table({"node": np.repeat(node, many), "row": rows[place], "vec_id": ids.take(pa.array(place)), "score": np.repeat(score, many)})

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, ef: int = EF_SEARCH, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK, links: int = LINKS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which ``is_query`` (over ``id``) holds, about the
    ``k`` other rows with the largest inner product, nearest first, ties to the smaller id (null last).

    Every row is indexed but those whose vector is null, empty, zero or has a component that is null or
    not finite. A query's candidates are the rows of its dimension but itself; a repeated row is
    another row. Fewer than ``k`` candidates are all returned. The search is approximate in which
    vectors it finds; scores are exact in double precision. Equal vectors are one point of a graph,
    whatever their number, and equal queries are asked once. Shards and blocks have bounded sizes.
    """
    if not 0 < k < ef:
        raise ValueError("ef must exceed k")
    spark = vectors.sparkSession
    rows = clean_vectors(vectors, id_col, vector_col).filter(F.exists("v", lambda x: x != 0))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    nodes = _distinct(rows, k + 1)
    index = build_index(nodes, shard_rows, links, max(EF_BUILD, links))

    asked = rows.filter(is_query).select(F.col("id").alias("query_id"), F.col("row").alias("query_row"), "dim", "v")
    wanted = materialize(asked.select("dim", "v").distinct())
    wanted = materialize(nodes.select("node", "dim", "v").join(wanted, ["dim", "v"], "left_semi"))
    shards = index.select("dim", F.col("shard").alias("of_shard"))
    parts = wanted.groupBy("dim").agg(F.ceil(F.count("*") / query_block).cast("int").alias("parts"))
    parts = materialize(parts)
    blocked = wanted.join(parts, "dim").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    left = blocked.join(shards, "dim").select(F.col("dim").alias("dim"), F.col("of_shard").alias("shard"), "part", "node", "v")
    right = index.join(parts, "dim").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    tasks = tasks_for(spark)
    tiles = lambda side: side.repartition(tasks, "dim", "shard", "part").groupBy("dim", "shard", "part")
    found = tiles(left).cogroup(tiles(right)).applyInArrow(_search(k + 1, ef, links), _FOUND)
    order = [F.desc("score"), F.col("vec_id").isNull(), "vec_id", "row"]
    best = found.withColumn("_rank", F.row_number().over(Window.partitionBy("node").orderBy(*order))).filter(F.col("_rank") <= k + 1)

    # The first k + 1 rows for a vector hold the first k for each row that has it.
    listed = materialize(best.groupBy("node").agg(F.collect_list(F.struct("row", "vec_id", "score")).alias("best")))
    named = materialize(nodes.select("node", "dim", "v").join(listed, "node").select("dim", "v", "best"))
    answers = asked.join(named, ["dim", "v"]).select("query_id", "query_row", F.explode("best").alias("b")).select("query_id", "query_row", "b.*").filter("row <> query_row")
    answers = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(*order))).filter(F.col("rank") <= k)
    return answers.select("query_id", "rank", "vec_id", "score")
