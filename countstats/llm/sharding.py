"""Sharding by a Feistel permutation with cycle walking over global row numbers, in DataFrame functions only."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import materialize

#: Rows are numbered in buckets of about so many each, and in 1024 buckets at least.
BUCKET_ROWS = 16_384
#: Rows alike from which on they are parted.
HOT_ROWS = 16_384
ROUNDS = 6
#: Steps of the walk that are laid out for every row; a row that needs more walks on by itself.
WALK = 64
_PRIME = (1 << 31) - 1
_ROOT = 48271  # generates all residues of _PRIME but 0


def _mixed(x: Column, factor: int) -> Column:
    """A number below _PRIME from any long."""
    return F.pmod(x, F.lit(_PRIME)) * F.lit(factor) % _PRIME


def _factor(seed: int, k: int) -> int:
    return pow(_ROOT, 2 * (97 * seed + k) + 101, _PRIME)


def _sides(n: int) -> tuple[int, int]:
    """Two near-equal factors of a domain that holds 0..n-1 and fewer than its first side more."""
    a = isqrt(n - 1) + 1
    return a, -(-n // a)


def permuted(number: Column, n: int, seed: int) -> Column:
    """Where the permutation of 0..n-1 chosen by ``seed`` puts ``number``.

    Each Feistel round adds a mix of one half to the other half, modulo that half's size, and so
    can be undone. The domain has at most sqrt(n) values too many; a value that lands on one of
    them walks on until it is inside.
    """
    a, b = _sides(n)
    rounds = F.array(*[F.struct(F.lit(k % 2 == 1).alias("odd"), F.lit(_factor(seed, 2 * k)).alias("f"), F.lit(_factor(seed, 2 * k + 1)).alias("g")) for k in range(ROUNDS)])

    def one_round(s: Column, r: Column) -> Column:
        y = F.when(r["odd"], s["l"]).otherwise(s["r"])
        t = (y + r["g"]) % _PRIME * r["f"] % _PRIME
        t = t.bitwiseXOR(F.shiftright(t, 15)) % _PRIME * r["g"] % _PRIME
        left = F.when(r["odd"], s["l"]).otherwise((s["l"] + t) % a)
        right = F.when(r["odd"], (s["r"] + t) % b).otherwise(s["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    def step(v: Column) -> Column:
        return F.aggregate(rounds, F.struct(((v - v % b) / b).cast("long").alias("l"), (v % b).alias("r")), one_round, lambda s: s["l"] * b + s["r"])

    walked = lambda start, most: F.aggregate(F.sequence(F.lit(1), most), start, lambda v, _: F.when(v < n, v).otherwise(step(v)))
    out = walked(step(number), F.lit(max(1, min(a, WALK))))
    # Of the at most ``a`` values outside none comes twice in a walk, so it ends within so many steps.
    return F.when(out < n, out).otherwise(walked(out, F.lit(a) + out * 0)) if a > WALK else out


def row_numbers(rows: DataFrame, keys: list[str], bucket: Column, buckets: int, hot: int) -> DataFrame:
    """``rows`` with ``_number``: 0, 1, ... over all rows by bucket, 0 to ``buckets`` - 1, and, in it, by ``keys``.

    Only the buckets' counts, a row for BUCKET_ROWS rows, meet in one task. Rows alike in ``keys`` of which there
    are more than ``hot`` come after all buckets, in parts of about so many, so that no task sorts them
    all; they may swap places.
    """
    many = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot)
    many = materialize(many.select(*[F.col(k).alias(f"_many_{k}") for k in keys], F.ceil(F.col("_n") / hot).alias("_parts")))
    placed = rows.withColumn("_bucket", bucket.cast("long"))
    if not many.isEmpty():
        same = [F.col(k).eqNullSafe(F.col(f"_many_{k}")) for k in keys]
        part = F.shiftleft(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)), 30) + F.pmod(F.monotonically_increasing_id(), F.col("_parts")) + buckets
        # Written, as a part must be the same whenever it is read.
        parted = materialize(rows.join(many, same).select(*rows.columns, part.alias("_bucket")))
        placed = placed.join(many, same, "left_anti").unionByName(parted)
    counts = placed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    in_bucket = F.row_number().over(Window.partitionBy("_bucket").orderBy(*[F.col(k).asc_nulls_first() for k in keys])) - 1
    numbered = placed.withColumn("_in_bucket", in_bucket)
    return numbered.join(starts, "_bucket").withColumn("_number", F.col("_start") + F.col("_in_bucket")).drop("_bucket", "_start", "_in_bucket")


def _as_long(docs: DataFrame) -> Column:
    integer = docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    return F.col("doc_id").cast("long") if integer else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))


def assign_shards(docs: DataFrame, shards: int = 40, seed: int = 7, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) with size, text_crc32, law, shard, slot, grown_shard.

    Rows are numbered in an order that depends on doc_id, size and text_crc32 only; the permuted
    number p gives shard p mod ``shards`` and slot p div ``shards``. So counts of shards are at most
    one apart (law ``rows``), slots have no gaps, and anyone can work out the place of a row number.
    A null text has size 16 and no checksum; null ids come first. Ids that are not integers count as
    their hash. Rows alike in these three columns may swap places; where there are very many, they are
    numbered after all others. Existing columns of the new names are replaced.
    """
    new = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("_row"), _as_long(docs).alias("_id"), size.alias("size"), F.crc32("text").alias("text_crc32"))
    n = docs.count()
    if n == 0:
        number = F.lit(0).cast("long")
    else:
        key = _mixed(F.coalesce("_id", F.lit(-1)), _ROOT) + _mixed(F.col("size"), _factor(1, 0)) + F.coalesce("text_crc32", F.lit(0))
        buckets = max(1024, n // BUCKET_ROWS)
        rows = row_numbers(rows, ["_id", "size", "text_crc32"], F.pmod(_mixed(key, _factor(1, 1)), F.lit(buckets)), buckets, HOT_ROWS)
        number = permuted(F.col("_number"), n, seed)
    placed = rows.withColumn("_at", number)
    return placed.select("_row.*", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("_at") % shards).cast("int").alias("shard"), ((F.col("_at") - F.col("_at") % shards) / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def oracle_sql(shards: int = 40, seed: int = 7) -> str:
    """The same placement in SQL: CRC-32 byte by byte, row numbers by bucket, and the rounds as a recursion."""
    rounds = ", ".join(f"({k}, {_factor(seed, 2 * k)}, {_factor(seed, 2 * k + 1)})" for k in range(ROUNDS))
    mixed = lambda x, f: f"((({x}) % {_PRIME} + {_PRIME}) % {_PRIME} * {f} % {_PRIME})"
    key = f"{mixed('coalesce(doc_id, -1)', _ROOT)} + {mixed('size', _factor(1, 0))} + coalesce(text_crc32, 0)"
    return f"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS tbl FROM (SELECT i, list_reduce([i] || range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))
), bytes AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 16 AS size, [CAST('0x' || h AS BIGINT) FOR h IN regexp_extract_all(hex(encode(text)), '..')] AS l FROM documents
), sums AS (
  SELECT doc_id, CAST(size AS BIGINT) AS size, xor(list_reduce([4294967295] || l, lambda c, x: xor(c >> 8, tbl[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM bytes, crc
), placed AS (
  SELECT *, {mixed(key, _factor(1, 1))} % (SELECT greatest(1024, count(*) // {BUCKET_ROWS}) FROM documents) AS bucket FROM sums
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32 NULLS FIRST) - 1 AS num FROM placed
), sides AS (
  SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS a, CAST(ceil(n / ceil(sqrt(n))) AS BIGINT) AS b FROM (SELECT count(*) AS n FROM documents)
), walk AS (
  SELECT num, num // b AS l, num % b AS r, 0 AS k FROM numbered, sides
  UNION ALL
  SELECT num, CASE WHEN k % 2 = 0 THEN (l + t) % a ELSE l END, CASE WHEN k % 2 = 1 THEN (r + t) % b ELSE r END, k + 1
  FROM (SELECT num, l, r, k, n, a, b, xor(t, t >> 15) % {_PRIME} * g % {_PRIME} AS t
        FROM (SELECT walk.*, sides.*, g, ((CASE WHEN k % 2 = 1 THEN l ELSE r END) + g) % {_PRIME} * f % {_PRIME} AS t
              FROM walk, sides, (VALUES {rounds}) AS rounds(j, f, g) WHERE j = k % {ROUNDS} AND (k = 0 OR k % {ROUNDS} <> 0 OR l * b + r >= n)))
), ended AS (
  SELECT num, l * b + r AS p FROM walk, sides WHERE k > 0 AND k % {ROUNDS} = 0 AND l * b + r < n
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(p % {shards} AS INTEGER) AS shard, p // {shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM numbered JOIN ended USING (num)
"""
