"""Benchmark decontamination: a broadcast hash set of test n-grams against every training window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import materialize
from .common import WORD_GAP, lower_ascii

#: Up to so many distinct windows, and bytes of their text, are broadcast; a larger set is shuffled.
MAX_BROADCAST_WINDOWS = 1_000_000
MAX_BROADCAST_BYTES = 128 << 20


def _words(text: Column) -> Column:
    """Words in order; the first and last entry may be empty, never one between."""
    return F.split(lower_ascii(text), WORD_GAP)


def _real_words(text: Column) -> Column:
    return F.filter(_words(text), lambda w: w != "")


def benchmark_windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Distinct windows of all items: ``n`` (words), ``hash``, ``window`` (text), ``items`` (item ids as strings).

    An item of fewer than ``n`` words, but not none, is one window. A null text has no window. A null
    item_id gives windows that no id stands for.
    """
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), _real_words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = words.select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1)))).alias("start"))
    windows = starts.select("item", F.slice("w", F.col("start"), F.lit(n)).alias("w"))
    grouped = windows.groupBy("w").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return grouped.select(F.size("w").alias("n"), _hash([F.get("w", F.lit(k)) for k in range(n)]).alias("hash"), F.array_join("w", " ").alias("window"), "items")


def _hash(words: list[Column]) -> Column:
    """Null stands for a word past the end; it leaves the hash as it is."""
    return F.xxhash64(*words)


def _spots(words: str, lengths: list[int]) -> Column:
    """(n, hash) of the windows of each length that begin at word ``_pos``."""
    return F.array(*[F.struct(F.lit(n).alias("n"), _hash([F.get(words, F.col("_pos") + i) for i in range(n)]).alias("hash")) for n in lengths])


def _found_by_broadcast(docs: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """_keep, n_words, spans, items: each position looks its windows up in the broadcast set; a match of
    hashes counts only if the words are equal."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "_keep", _words(F.col("_text")).alias("_words"))
    at = rows.select("_row", "_keep", "_words", F.posexplode_outer("_words").alias("_pos", "_word"))
    spots = _spots("_words", lengths)
    at = at.withColumn("_key", F.get(spots, F.lit(0)) if len(lengths) == 1 else F.explode_outer(spots) if lengths else F.lit(None).cast("struct<n:int,hash:bigint>"))
    at = at.withColumn("_n", F.col("_key.n")).withColumn("_hash", F.col("_key.hash"))
    window = F.array_join(F.slice("_words", F.col("_pos") + 1, F.col("_n")), " ")
    # Two inequalities: an equality would become a second join key, built for every position.
    verified = (window <= F.col("window")) & (window >= F.col("window"))
    same = (F.col("_hash") == F.col("hash")) & (F.col("_n") <= F.col("n")) & verified
    hit = F.col("window").isNotNull()
    found = at.join(F.broadcast(windows), same, "left").filter(hit | F.coalesce(F.col("_pos") == 0, F.lit(True)))
    span = F.when(hit, F.struct((F.col("_pos") - _blank()).alias("start"), (F.col("_pos") - _blank() + F.col("n")).alias("end")))
    found = found.select("_row", "_keep", _n_words().alias("n_words"), span.alias("span"), "items")
    grouped = found.groupBy("_row").agg(F.first("_keep").alias("_keep"), F.max("n_words").alias("n_words"), F.collect_set("span").alias("spans"), F.collect_set("items").alias("items"))
    return grouped.select("_keep", "n_words", "spans", "items")


def _found_by_shuffle(docs: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """The same where the windows are too many for a broadcast. Hits depend on the text alone: the
    positions go to the windows as (digest of the text, position, hash), and only candidates, whose
    windows have an equal hash, come back to the words and are verified there."""
    windows = materialize(windows)  # so that the join meets two plain exchanges and a common phrase can be split
    keyed = docs.select(*_text_key(F.col("_text")), _words(F.col("_text")).alias("_words"))
    at = keyed.select("_k1", "_k2", "_k3", F.posexplode("_words").alias("_pos", "_word"), "_words")
    at = at.select("_k1", "_k2", "_k3", "_pos", F.explode(_spots("_words", lengths)).alias("_key")).select("_k1", "_k2", "_k3", "_pos", "_key.*")
    met = at.join(windows, ["n", "hash"]).groupBy("_k1", "_k2", "_k3").agg(F.collect_set(F.struct("_pos", "n", "window", "items")).alias("_met"))
    met = materialize(met).withColumnsRenamed({f"_k{i}": f"_m{i}" for i in (1, 2, 3)})
    rows = docs.select("_keep", _words(F.col("_text")).alias("_words"), *_text_key(F.col("_text")))
    rows = rows.join(met, [F.col(f"_k{i}") == F.col(f"_m{i}") for i in (1, 2, 3)], "left")
    true = F.filter("_met", lambda m: F.array_join(F.slice("_words", m["_pos"] + 1, m["n"]), " ") == m["window"])
    true = F.coalesce(true, F.array().cast(met.schema["_met"].dataType))
    spans = F.transform(true, lambda m: F.struct((m["_pos"] - _blank()).alias("start"), (m["_pos"] - _blank() + m["n"]).alias("end")))
    return rows.select("_keep", _n_words().alias("n_words"), F.array_distinct(spans).alias("spans"), F.transform(true, lambda m: m["items"]).alias("items"))


def _blank() -> Column:
    """1 if the text begins with a gap, so that the first entry of its words is empty."""
    return (F.get("_words", F.lit(0)) == "").cast("int")


def _n_words() -> Column:
    last = ((F.size("_words") > 1) & (F.element_at("_words", -1) == "")).cast("int")
    return F.when(F.col("_words").isNull(), 0).otherwise(F.size("_words") - _blank() - last)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: ``keep`` and n_words, n_hit, n_items, items_sha256, contaminated, spans.

    A word inside any occurrence of a benchmark window is hit; ``spans`` has the occurrences as
    (start, end) word positions. Every word position of a document looks its window up in the
    broadcast hash set, and a match counts only if the words are equal. A benchmark too large for a
    broadcast is joined by a shuffle of the positions instead.

    Null and empty texts have no words and are clean. Repeated rows stay apart. Columns other than
    ``keep`` and ``text`` are ignored; those of ``keep`` that have the name of a result are replaced.
    An empty benchmark leaves all clean.
    """
    new = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")
    windows = benchmark_windows(benchmark, n)
    sizes = windows.agg(F.count("*").alias("count"), F.coalesce(F.sum(F.octet_length("window")), F.lit(0)).alias("bytes"), F.sort_array(F.collect_set("n")).alias("lengths")).first()
    small = sizes["count"] <= MAX_BROADCAST_WINDOWS and sizes["bytes"] <= MAX_BROADCAST_BYTES
    source = docs.select(F.struct(*[F.col(c) for c in keep if c not in new]).alias("_keep"), F.col("text").alias("_text"))
    found = (_found_by_broadcast if small else _found_by_shuffle)(source, windows, sizes["lengths"])
    found = found.select("_keep", F.col("n_words").cast("long").alias("n_words"), F.array_sort("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["start"]))).alias("n")),
    )["n"]
    out = found.select("_keep", "n_words", covered.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "spans")
    return out.select("_keep.*", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "spans")


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("_k1"), F.crc32(text).alias("_k2"), F.octet_length(text).alias("_k3")]


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "documents") -> DataFrame:
    """``docs`` without contaminated documents, or with ``remove='spans'`` without the hit words.

    Whether a document is hit depends on its text alone, so a digest of the text joins the findings
    back to whole rows; all columns stay. Removing spans drops each hit word together with the
    separators before it. Null and empty texts stay.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be 'documents' or 'spans', not {remove!r}")
    keyed = docs.select(F.col("text"), *_text_key(F.col("text")))
    hits = contamination(keyed, benchmark, n, ("_k1", "_k2", "_k3")).filter("contaminated").select("_k1", "_k2", "_k3", "spans").dropDuplicates(["_k1", "_k2", "_k3"])
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("text"), *_text_key(F.col("text")))
    if remove == "documents":
        return rows.drop("text").join(hits, ["_k1", "_k2", "_k3"], "left_anti").select("_doc.*")
    pieces = F.regexp_extract_all(F.col("text"), F.lit(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+$"), F.lit(0))
    hit_at = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1))))
    kept = F.array_join(F.transform(F.filter(F.arrays_zip(F.sequence(F.lit(0), F.size("_pieces") - 1).alias("i"), F.col("_pieces").alias("p")), lambda z: ~F.array_contains(F.col("_hit_at"), z["i"])), lambda z: z["p"]), "")
    joined = rows.join(hits, ["_k1", "_k2", "_k3"], "left").withColumn("_pieces", pieces).withColumn("_hit_at", hit_at)
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(kept)
    return joined.select(F.col("_doc").withField("text", text).alias("_doc")).select("_doc.*")


ORACLE = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM item_words WHERE len(w) > 0)
), spots AS (
  SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM words
), hits AS (
  SELECT a.r, a.p, b.n, b.item FROM spots a, (SELECT DISTINCT n FROM windows) l, windows b
  WHERE a.p + l.n - 1 <= len(a.w) AND b.n = l.n AND b.win = array_to_string(a.w[a.p:a.p + l.n - 1], ' ')
), covered AS (
  SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM hits)) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""
