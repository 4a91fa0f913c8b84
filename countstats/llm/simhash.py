"""SimHash near-duplicates: word-shingle fingerprints, pigeonhole blocks, verified links, components."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import materialize
from .common import by_bytes, tasks_for
from .components import connected_components

BITS = 64
#: A bucket of at most so many fingerprints is joined with itself; a larger one is linked through its one-bit neighbourhoods.
PAIR_BUCKET = 32
#: A bucket of more rows is split into tiles of half as many.
TILE = 2048
#: One node in so many is counted to find these buckets.
_COUNTED = 32
#: So many such buckets are sent to all tasks; with more, rows are shuffled to meet them.
_FEW = 100_000
#: Shingle fingerprints of texts at cosine 0.8 differ in 13 of 64 bits on average, hardly ever in more than this.
CANDIDATE_BITS = 20
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _hashes(words: list[bytes], shingle: int, seed: int) -> np.ndarray:
    """A hash for each shingle of ``words``, repeats included; fewer words than ``shingle`` are one."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], dtype=np.uint64)
    shingles = map(b" ".join, zip(*(islice(words, k, None) for k in range(shingle))))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype=np.uint64, count=len(words) - shingle + 1)


def _fingerprint_batch(hashes: list[np.ndarray]) -> np.ndarray:
    """Unsigned fingerprints: a bit is set if it is in over half of the hashes; 0 without any."""
    counts = np.array([len(h) for h in hashes], dtype=np.int64)
    lanes = np.concatenate([*hashes, np.zeros(0, np.uint64)]).astype("<u8").view(np.uint8).reshape(-1, 8)
    base = np.repeat(np.arange(len(hashes), dtype=np.int64) * 256, counts)
    bits = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
    out = np.zeros(len(hashes), dtype=np.uint64)
    for lane in range(8):
        histogram = np.bincount(base + lanes[:, lane], minlength=len(hashes) * 256).reshape(-1, 256)
        most = (2 * (histogram @ bits) > counts[:, None]).astype(np.uint64)
        out |= (most << (np.arange(8, dtype=np.uint64) + np.uint64(8 * lane))).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, shingle: int = 5, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", with_sets: bool = False) -> DataFrame:
    """``id_col``, ``fp`` and, if ``with_sets``, ``word_fp`` (fingerprints as signed longs) and ``set`` for every row.

    Words lie between ASCII white space, A-Z count as a-z. A text of fewer words than ``shingle``
    is one shingle; a null or empty one has fingerprint 0. ``word_fp`` is the fingerprint of the
    set of words without punctuation, ``set`` a digest of 128 bits of the set of shingles. All other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 1):
                texts = [(t or b"").lower() for t in part.column(1).cast(pa.binary()).to_pylist()]
                hashes = [_hashes(t.split(), shingle, seed) for t in texts]
                fp, more = _fingerprint_batch(hashes), []
                if with_sets:
                    word_fp = _fingerprint_batch([_hashes(list(dict.fromkeys(_WORD.findall(t))), 1, seed) for t in texts])
                    more = [pa.array(word_fp.view(np.int64)), pa.array([xxhash.xxh3_128_digest(np.unique(h).tobytes()) for h in hashes], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64)), *more], names=["id", "fp", "word_fp", "set"][: 2 + len(more)])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    fields = [T.StructField("id", source.schema["id"].dataType), T.StructField("fp", T.LongType()), *[T.StructField("word_fp", T.LongType()), T.StructField("set", T.BinaryType())][: 2 * with_sets]]
    return source.mapInArrow(run, T.StructType(fields)).withColumnRenamed("id", id_col)


def _block_masks(distance: int, blocks: int) -> list[int]:
    """Masks of all choices of ``blocks - distance`` blocks: two fingerprints that differ in at most
    ``distance`` bits agree on at least one of them."""
    if not distance < blocks <= BITS:
        raise ValueError(f"needs more blocks than differing bits, and {BITS} at most")
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(parts[i] for i in keep) for keep in combinations(range(blocks), blocks - distance)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def links(fps: DataFrame, distance: int = 2, blocks: int = 5, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """Edges (a, b) that connect all fingerprints at ``distance`` or fewer differing bits (at most 2).

    ``fps`` holds distinct longs in ``fp``. Each fingerprint is put into one bucket for every choice
    of blocks; buckets of one fall away. Members of a small bucket are joined and verified by their
    Hamming distance. A large bucket never makes pairs: each member lists itself and the values one
    bit away, and those that list the same value differ by two bits at most. So a star around the
    smallest of them has the same components as all their links; both ways are exact.
    """
    if not 0 <= distance <= 2:
        raise ValueError("distance must be 0, 1 or 2")
    masks = _block_masks(distance, blocks)
    key = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)]))
    buckets = fps.select("fp", key.alias("b")).select("fp", "b.choice", "b.key")
    # Written first, as the other small sides below, so that a hot key can be split over tasks.
    sizes = materialize(buckets.groupBy("choice", "key").agg(F.count("*").alias("n")).filter("n > 1"))
    members = materialize(buckets.join(sizes, ["choice", "key"]))

    small = members.filter(F.col("n") <= pair_bucket)
    other = small.select("choice", "key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= distance
    pairs = small.join(other, ["choice", "key"]).filter((F.col("fp") < F.col("b")) & near).select(F.col("fp").alias("a"), "b")

    large = members.filter(F.col("n") > pair_bucket).select("fp").distinct()
    return pairs.union(_stars(large, distance)).distinct()


def _stars(fps: DataFrame, distance: int) -> DataFrame:
    if distance == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(BITS)])
    listed = fps.select("fp", F.explode(flips).alias("flip")).select("fp", (F.col("flip") == 0).alias("own"), F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    listed = materialize(listed)
    if distance == 1:  # only a value that is itself a fingerprint links its neighbours to it
        points = listed.filter("own").select("point")
        return listed.filter("not own").join(points, "point").select(F.least("fp", "point").alias("a"), F.greatest("fp", "point").alias("b"))
    hubs = materialize(listed.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    return listed.join(hubs, "point").filter(F.col("a") < F.col("fp")).select("a", F.col("fp").alias("b"))


def near_duplicates(docs: DataFrame, shingle: int = 5, distance: int = 2, blocks: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``fp`` and ``component_id`` (the smallest id reachable over links) for every row.

    Equal fingerprints are one node, so copies make no pairs. Rows whose id is null get the
    component's smallest id, or null if it has none. An empty table gives no rows.
    """
    rows = materialize(fingerprints(docs, shingle, id_col=id_col, text_col=text_col))
    nodes = rows.groupBy("fp").agg(F.min(id_col).alias("_first"))
    edges = materialize(links(nodes.select("fp"), distance, blocks))
    labels = connected_components(edges)
    parts = materialize(nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", F.coalesce("label", "fp").alias("label"), "_first"))
    smallest = materialize(parts.groupBy("label").agg(F.min("_first").alias("component_id")))
    named = materialize(parts.join(smallest, "label").select("fp", "component_id"))
    return rows.join(named, "fp").select(id_col, "fp", "component_id")


def shingle_sets(docs: DataFrame, shingle: int = 5, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``shingles``: the distinct shingles of each row's text (see ``fingerprints``), as sorted
    32-bit hashes in a binary; empty without words."""

    def one(text: bytes | None) -> bytes:
        hashes = _hashes((text or b"").lower().split(), shingle, seed)
        return np.unique((hashes >> np.uint64(32)).astype(np.uint32)).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([one(t.as_py()) for t in part.column(1).cast(pa.binary())], pa.binary())], names=["id", "shingles"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("shingles", T.BinaryType())])
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def verified(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``edges`` (a, b) whose shingle sets, of ``sets`` (node, shingles), have a cosine of
    ``similarity`` at least: shared shingles over the geometric mean of both numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_py(), dtype=np.uint32) for v in (one, two))
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(shared >= similarity * (len(x) * len(y)) ** 0.5 - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda side: sets.select(F.col("node").alias(side), F.col("shingles").alias(f"{side}_shingles"))
    return edges.join(of("a"), "a").join(of("b"), "b").select("a", "b", "a_shingles", "b_shingles").mapInArrow(run, "a bigint, b bigint")


def _forest(fps: np.ndarray, word_fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the two ends of each link of a minimum spanning forest: of links between fingerprints that
    differ in ``distance`` bits at most, nearest first by the bits in which both fingerprints differ. Fewer
    links than nodes, whatever the number of close pairs, and each node's nearest is among them."""

    def gaps(to: np.ndarray, at: int) -> np.ndarray:
        gap = np.bitwise_count(fps[to] ^ fps[at]).astype(np.int64)
        return np.where(gap <= distance, gap + np.bitwise_count(word_fps[to] ^ word_fps[at]), 1 << 20)

    left, a, b = np.arange(1, len(fps)), [], []
    near, parent = np.append(0, gaps(left, 0)), np.zeros(len(fps), dtype=np.int64)
    while len(left):
        at = int(near[left].argmin())
        new = left[at]
        left = np.delete(left, at)
        if near[new] < 1 << 20:
            a.append(parent[new])
            b.append(new)
        gap = gaps(left, new)
        closer = gap < near[left]
        near[left[closer]], parent[left[closer]] = gap[closer], new
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def _scan(distance: int):
    """Links within each bucket, of rows (key, fp, word_fp, node) sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.zeros((0, 4), dtype=np.int64)
        for batch in chain(batches, [None]):
            if batch is not None:
                rows = np.concatenate([rows, np.column_stack([c.to_numpy() for c in batch.columns])])
            change = np.ones(len(rows), dtype=bool)
            change[1:] = rows[1:, 0] != rows[:-1, 0]
            starts = np.flatnonzero(change)
            ends = np.append(starts[1:], len(rows))
            if batch is not None:  # the last bucket may go on
                starts, ends = starts[:-1], ends[:-1]
            done = ends[-1] if len(ends) else 0
            fps, word_fps, nodes = (rows[:, i].copy() for i in (1, 2, 3))
            fps, word_fps = fps.view(np.uint64), word_fps.view(np.uint64)
            two = starts[ends - starts == 2]
            two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= distance]
            a, b = [nodes[two]], [nodes[two + 1]]
            for s, e in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist()):
                x, y = _forest(fps[s:e], word_fps[s:e], distance)
                a.append(nodes[s:e][x])
                b.append(nodes[s:e][y])
            rows = rows[done:]
            links = np.column_stack([np.concatenate(a), np.concatenate(b)])
            links.sort(axis=1)
            links = np.unique(links, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    return run


def similar_links(nodes: DataFrame, distance: int = CANDIDATE_BITS, agreeing: int = 3, blocks: int = 9) -> DataFrame:
    """Candidate edges (a, b), a < b, over the ``node`` of ``nodes`` (node, fp, word_fp), longs.

    Two nodes may be linked if their word fingerprints agree on ``agreeing`` of ``blocks`` blocks, as any
    two that differ in ``blocks - agreeing`` bits do, and their shingle fingerprints differ in ``distance``
    bits at most; or if these are equal. A bucket makes a minimum spanning forest of these links, never all pairs. One of over
    TILE nodes, by a count over a 32nd of them, is split into tiles of half as many before its rows
    come together, and each two tiles meet in a task of their own.
    """
    masks = F.array(*[F.struct(F.lit(i).alias("choice"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(_block_masks(blocks - agreeing, blocks))])
    keys = F.transform(masks, lambda m: F.xxhash64(m["choice"], F.col("word_fp").bitwiseAND(m["mask"])))
    keyed = nodes.select("node", "fp", "word_fp", F.explode(F.array_append(keys, F.xxhash64("fp"))).alias("key"))
    some = keyed.filter(F.pmod(F.xxhash64("node", F.lit("count")), F.lit(_COUNTED)) == 0).groupBy("key").agg(F.count("*").alias("n"))
    tiles = materialize(some.filter(F.col("n") * _COUNTED > TILE).select("key", F.ceil(F.col("n") * _COUNTED / (TILE / 2)).cast("int").alias("tiles")))

    if (n := tiles.count()) > 0:
        tiles = F.broadcast(tiles) if n <= _FEW else tiles
        own = F.pmod(F.xxhash64("node", F.lit("tile")), F.col("tiles")).cast("long")
        hot = keyed.join(tiles, "key").withColumn("tile", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles").cast("long") - 1)))
        # Two buckets that share a hash only bring more candidates.
        hot = hot.select("node", "fp", "word_fp", F.xxhash64("key", F.least("tile", "other"), F.greatest("tile", "other")).alias("key"))
        keyed = keyed.join(tiles.select("key"), "key", "left_anti").select("node", "fp", "word_fp", "key").union(hot)
    dealt = keyed.select("key", "fp", "word_fp", "node").repartition(tasks_for(nodes.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(_scan(distance), "a bigint, b bigint").distinct()


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: that of its smallest doc_id.

    Two texts are near-duplicates if the cosine of their sets of ``shingle``-word shingles, which
    SimHash estimates, is ``similarity`` at least; at 0.8 that takes in every pair of Jaccard similarity
    0.67 or more. Candidates are those of ``similar_links``, and each is verified on the sets. Texts of
    one set, by a digest of 128 bits, are a node; texts that only share a fingerprint are compared.

    Rows that repeat the smallest doc_id are told apart by a hash of the whole row; rows that are alike
    in all columns count as one. A component without a doc_id keeps one row. Null and empty texts are alike.
    """
    hashed = F.xxhash64(*[F.col(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    marked = docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", hashed.alias("_row"))
    keyed = marked.select(F.struct("doc_id", "_row").alias("_key"), F.col("_doc.text").alias("text"))
    rows = materialize(fingerprints(keyed, shingle, id_col="_key", with_sets=True).select("_key.doc_id", "_key._row", "fp", "word_fp", "set"))
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "_row")
    nodes = rows.groupBy("set").agg(F.min(order).alias("first"), F.min("fp").alias("fp"), F.min("word_fp").alias("word_fp"))
    nodes = materialize(nodes.drop("set").withColumn("node", F.monotonically_increasing_id()))
    edges = materialize(similar_links(nodes))

    ends = materialize(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct())
    first = materialize(nodes.join(ends, "node", "left_semi").select("node", F.col("first.doc_id").alias("doc_id"), F.col("first._row").alias("_row")))
    sets = shingle_sets(keyed, shingle, id_col="_key").select(F.col("_key.doc_id").alias("d"), F.col("_key._row").alias("r"), "shingles")
    sets = sets.join(first, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("r") == F.col("_row"))).select("node", "shingles").dropDuplicates(["node"])
    labels = connected_components(verified(edges, materialize(sets), similarity)).withColumnRenamed("node", "_node")

    # A node's rows were reduced to its first one before, so a component has a row for each set.
    best = nodes.join(labels, F.col("node") == F.col("_node"), "left").groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("first").alias("best"))
    keep = best.select(F.col("best.doc_id").alias("doc_id"), F.col("best._row").alias("_row"))
    joined = marked.alias("d").join(keep.alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d._row") == F.col("k._row")), "left_semi")
    return joined.dropDuplicates(["doc_id", "_row"]).select("_doc.*")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
