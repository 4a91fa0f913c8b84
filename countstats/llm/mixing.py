"""Mixing sources to target weights: fixed-length blocks, multinomial counts for each output shard,
pseudorandom index permutations, and a join of slots and blocks by index."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import materialize
from .common import by_bytes, count_words, tasks_for

#: Words of a block at most. A source whose target is less than SLOTS times that has shorter blocks, so
#: that rounding to whole slots stays below half a percent of any target.
BLOCK = 64
SLOTS = 100
SHARDS = 64
MAX_REPEAT = 3
#: Rows of a source are summed in buckets of about so many, so that no task sums a whole hot source.
BUCKET_ROWS = 16_384
#: One row for each source passes through the driver; up to so many are also broadcast.
MAX_BROADCAST_SOURCES = 100_000
_SLOTS_A_ROW = 100_000


def targets(sizes: np.ndarray, weights: np.ndarray, repeat: int = MAX_REPEAT) -> np.ndarray:
    """Shares of the total of all sizes by weight; what lies above ``repeat`` times a size is shared
    anew among the others by weight, until nothing lies above."""
    out, free, rest = np.zeros(len(sizes)), np.ones(len(sizes), dtype=bool), float(sizes.sum())
    while free.any():
        share = rest * weights / weights[free].sum()
        over = free & (share > repeat * sizes)
        if not over.any():
            out[free] = share[free]
            break
        out[over] = repeat * sizes[over]
        free &= ~over
        rest = max(0.0, float(sizes.sum()) - float(out[~free].sum()))
    return out


def shard_counts(slots: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shard, source) counts. Each shard draws its sources from a multinomial whose probabilities
    are the slots that the sources have left; what a source lacks is drawn again. So shards are of
    near equal length and each source ends at its number of slots."""
    rng, left = np.random.default_rng(seed), slots.astype(np.int64).copy()
    counts = np.zeros((shards, len(slots)), dtype=np.int64)
    for shard in range(shards):
        need = int(left.sum()) // (shards - shard)
        while need > 0:
            drawn = np.minimum(rng.multinomial(need, left / left.sum()), left)
            counts[shard] += drawn
            left -= drawn
            need -= int(drawn.sum())
    return counts


def _hashed(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A 64-bit mix (splitmix64's finaliser, a public constant of that generator)."""
    z = x + key * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Image of each index under the permutation of 0..n-1 that ``key`` chooses: a Feistel network
    on two near-equal sides, walked until the value is below n."""
    index, n, key = (np.asarray(x).astype(np.uint64) for x in (index, n, key))
    a = np.ceil(np.sqrt(n.astype(np.float64))).astype(np.uint64)
    b = (n + a - np.uint64(1)) // a
    out, todo = index.copy(), np.arange(len(index))
    while len(todo):
        sides = [a[todo], b[todo]]
        halves = [out[todo] // sides[1], out[todo] % sides[1]]
        for k in range(rounds):
            one = k % 2
            halves[one] = (halves[one] + _hashed(halves[1 - one], key[todo] * np.uint64(rounds) + np.uint64(k)) % sides[one]) % sides[one]
        out[todo] = halves[0] * sides[1] + halves[1]
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def block_counts(sizes: np.ndarray, target: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """How many blocks each source is cut into. Its words are spread evenly: block j of m holds the words
    from j * size // m up to (j + 1) * size // m, so that blocks of a source differ by one word at most."""
    length = np.clip(target // SLOTS, 1, block).astype(np.int64)
    return -(-sizes // length)


def _streams(docs: DataFrame, keep: list[str], buckets: int) -> DataFrame:
    """Rows with their size, their bucket, and what ``keep`` names."""
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("_row"), F.col("source").cast("string").alias("_source"), F.col("doc_id").alias("_id"), count_words(F.col("text")).alias("_size"), F.xxhash64("text").alias("_hash"))
    return rows.withColumn("_bucket", F.pmod(F.xxhash64("_id", "_size", "_hash"), F.lit(buckets)))


def _plan(docs: DataFrame, seed: int, block: int, shards: int) -> tuple[pd.DataFrame, DataFrame, DataFrame, int]:
    """The sources with their targets; the first word of each bucket; how often each block is taken;
    the number of buckets."""
    spark = docs.sparkSession
    parts = max(1024, docs.count() // BUCKET_ROWS)
    narrow = _streams(docs, ["doc_id"], parts)
    buckets = materialize(narrow.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_words")))
    order = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select("_source", "_bucket", F.coalesce(F.sum("_words").over(order), F.lit(0)).alias("_start"))

    sources = buckets.groupBy("_source").agg(F.sum("_words").alias("size")).orderBy(F.col("_source").asc_nulls_last()).toPandas()
    sizes = sources["size"].to_numpy(dtype=np.int64) if len(sources) else np.zeros(0, dtype=np.int64)
    sources["rank"] = np.arange(len(sources))
    sources["target"] = targets(sizes, np.arange(len(sources)) % 3 + 1.0)
    sources["blocks"] = blocks = block_counts(sizes, sources["target"].to_numpy(), block)
    # A slot brings size / blocks words on average.
    slots = np.minimum(MAX_REPEAT * blocks, np.rint(sources["target"].to_numpy() * blocks / np.maximum(sizes, 1))).astype(np.int64)

    counts = shard_counts(slots, shards, seed)
    first = np.cumsum(counts, axis=0) - counts
    shard, rank = np.nonzero(counts)
    drawn = pd.DataFrame({"shard": shard, "rank": rank, "first": first[shard, rank], "n": counts[shard, rank], "blocks": blocks[rank]})
    drawn = spark.createDataFrame(drawn, "shard long, rank long, first long, n long, blocks long")
    return sources, starts, _taken_blocks(drawn, seed), parts


def _taken_blocks(drawn: DataFrame, seed: int) -> DataFrame:
    """(rank, block, times): slot t of a source takes the block at t's place in the permutation of
    its round, so each round takes a block once."""

    @F.pandas_udf(T.LongType())
    def place(slot: pd.Series, rank: pd.Series, blocks: pd.Series) -> pd.Series:
        slot, rank, blocks = (x.to_numpy(dtype=np.int64) for x in (slot, rank, blocks))
        key = ((rank + 1) * 7_919 + slot // blocks) * 1_000_003 + seed
        return pd.Series(permute(slot % blocks, blocks, key))

    last = F.col("first") + F.col("n") - 1
    parts = drawn.select("rank", "blocks", last.alias("last"), F.explode(F.sequence("first", last, F.lit(_SLOTS_A_ROW))).alias("from"))
    parts = parts.repartition(tasks_for(drawn.sparkSession), "rank", "from")  # few bytes, but many slots each
    slots = parts.select("rank", "blocks", F.explode(F.sequence("from", F.least(F.col("from") + _SLOTS_A_ROW - 1, "last"))).alias("slot"))
    return slots.select("rank", place("slot", "rank", "blocks").alias("block")).groupBy("rank", "block").agg(F.count("*").alias("times"))


def _located(docs: DataFrame, keep: list[str], plan: tuple) -> DataFrame:
    """Rows with the place of their first word in their source's stream, and their source's figures."""
    spark, (sources, starts, _, parts) = docs.sparkSession, plan
    figures = spark.createDataFrame(
        [(None if pd.isna(s) else s, int(r), int(n), int(m), float(t)) for s, r, n, m, t in zip(*(sources[c] for c in ("_source", "rank", "size", "blocks", "target")))],
        "_s string, _rank long, _source_size long, _blocks long, _target double",
    )
    starts = starts.withColumnsRenamed({"_source": "_s2", "_bucket": "_b2"})
    if len(sources) <= MAX_BROADCAST_SOURCES:
        figures = F.broadcast(figures)
    within = Window.partitionBy("_source", "_bucket").orderBy("_id", "_size", "_hash").rowsBetween(Window.unboundedPreceding, -1)
    rows = _streams(docs, keep, parts).withColumn("_before", F.coalesce(F.sum("_size").over(within), F.lit(0)))
    rows = rows.join(starts, F.col("_source").eqNullSafe(F.col("_s2")) & (F.col("_bucket") == F.col("_b2")))
    rows = rows.join(figures, F.col("_source").eqNullSafe(F.col("_s")))
    return rows.select("_row", "_id", "_size", "_rank", "_source_size", "_blocks", "_target", (F.col("_start") + F.col("_before")).alias("_at"))


def _pieces(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """For each row with words and each of its blocks: how many of its words lie in it, and times."""
    whole = lambda c: c.cast("decimal(38,0)")  # noqa: E731  a place times the number of blocks may pass 2 ** 63
    over = lambda a, b: F.expr(f"cast(({a}) div ({b}) as bigint)")
    wide = rows.filter("_size > 0").withColumns({"_m": whole(F.col("_blocks")), "_n": whole(F.col("_source_size"))})
    # Word w lies in block ((w + 1) * m - 1) // n, for block j begins at j * n // m.
    spans = wide.withColumn("_block", F.explode(F.sequence(over("(_at + 1) * _m - 1", "_n"), over("(_at + _size) * _m - 1", "_n"))))
    start = F.greatest(F.col("_at"), over("_block * _n", "_m"))
    end = F.least(F.col("_at") + F.col("_size"), over("(_block + 1) * _n", "_m"))
    joined = spans.join(taken, (F.col("_rank") == F.col("rank")) & (F.col("_block") == F.col("block")), "left")
    return joined.withColumn("_first", start - F.col("_at")).withColumn("_words", end - start).withColumn("_times", F.coalesce("times", F.lit(0)))


def mix_report(docs: DataFrame, seed: int = 11, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row of ``docs``.

    The words of a source form one stream, packed into blocks of one length, ``block`` words or, for a
    small target, fewer; see ``block_counts``. Sources by code point, null last, weigh 1, 2, 3,
    repeating; see ``targets``. ``taken`` counts a row's words in
    the blocks that the mix takes, repeats included: at most three times its size. The draw depends
    on doc_id, text and source alone, so reruns agree; rows alike in these may swap. Rows that only share
    an id, or have none, are dealt to buckets by their texts. A null or empty
    text has size 0 and gives nothing. Other columns are ignored.
    """
    plan = _plan(docs, seed, block, shards)
    rows = materialize(_located(docs, ["doc_id"], plan))
    key = ["_id", "_size", "_rank", "_source_size", "_target", "_at"]
    words = _pieces(rows, plan[2]).groupBy(*key).agg(F.sum(F.col("_words") * F.col("_times")).cast("long").alias("taken"))
    empty = rows.filter("_size = 0").select(*key, F.lit(0).cast("long").alias("taken"))
    return words.union(empty).select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), "taken")


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _copies(text: str, spans: list[dict], size: int) -> Iterator[str]:
    """The text of each copy: the first holds the words taken once at least, and so on."""
    spans = sorted(spans, key=lambda s: s["first"])
    for copy in range(1, MAX_REPEAT + 1):
        runs: list[list[int]] = []
        for s in spans:
            if s["times"] >= copy:
                if runs and runs[-1][1] == s["first"]:
                    runs[-1][1] += s["words"]
                else:
                    runs.append([s["first"], s["first"] + s["words"]])
        if not runs:
            return
        if runs == [[0, size]]:
            yield text
            continue
        words = [m.span() for m in _WORD.finditer(text)]
        yield "\n".join(text[words[a][0] : words[b - 1][1]] for a, b in runs)


def mix(docs: DataFrame, seed: int = 11, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """The mixed corpus, with the columns of ``docs``: a row for each copy of a document that the mix
    takes words of. Copy k has the words taken at least k times, so a document taken in part has
    only those words. n_chars, if there, is set to the new length. Documents without words are left
    out, as no block holds any of theirs."""
    plan = _plan(docs, seed, block, shards)
    rows = _located(docs, docs.columns, plan)
    # Narrow rows go through the blocks; the texts meet their spans once, by their place in the stream.
    narrow = materialize(_located(docs, ["doc_id"], plan))
    spans = _pieces(narrow, plan[2]).filter("_times > 0").groupBy("_rank", "_at").agg(F.collect_list(F.struct(F.col("_first").alias("first"), F.col("_words").alias("words"), F.col("_times").alias("times"))).alias("_spans"))
    # The text travels once, beside its row: in it, it is null until the copies are there.
    bare = F.col("_row").withField("text", F.lit(None).cast("string"))
    found = rows.filter("_size > 0").join(spans, ["_rank", "_at"]).select(bare.alias("_row"), F.col("_row.text").alias("_text"), "_spans", "_size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 1):
                index, texts = [], []
                for i, row in enumerate(zip(*(part.column(c).to_pylist() for c in (1, 2, 3)))):
                    for copy in _copies(*row):
                        index.append(i)
                        texts.append(copy)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(index, pa.int64())), pa.array(texts, pa.string())], names=["_row", "_text"])

    schema = T.StructType([found.schema["_row"], T.StructField("_text", T.StringType())])
    out = found.mapInArrow(run, schema)
    row = F.col("_row").withField("text", F.col("_text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("_text").cast(docs.schema["n_chars"].dataType))
    return out.select(row.alias("_row")).select("_row.*")
