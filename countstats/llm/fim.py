"""Fill-in-middle: texts cut at line ends into prefix, middle and suffix, and put together with marks for training."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What is cut between: lines with their end, or the rest of a text. One match of all units keeps every
#: repetition of the group; possessive, so that a long text leaves nothing to go back to.
UNITS = regex.compile(r"([^\n]*+\n|[^\n]++)*+")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = (PREFIX, SUFFIX, MIDDLE)
#: Texts that are turned into Python objects and held before they are passed on, in bytes; one text at least.
_SLICE_BYTES = 2 << 20


def cut(text: str, key: str, rate: int = 100, spm_share: int = 50) -> tuple[int, str, int | None, int | None, str]:
    """n units, form, characters of prefix and of middle (None if plain), and the output for ``text``.

    Four numbers h1 to h4 are the first groups of 8 digits of ``key``'s hex sha256. The prefix ends after
    the smaller of h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger.
    """
    ends = UNITS.fullmatch(text).ends(1)
    n = len(ends)
    digest = hashlib.sha256(key.encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in _MARKS) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_share:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm_share: int = 50, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``keep`` (all columns by default) with n, form (``plain``, ``psm``, ``spm``), prefix_chars,
    middle_chars (code points, null if plain) and ``output`` for every row.

    A text stays as it is (``plain``) if it is empty or null, holds a mark, or is not among the ``rate``
    percent to be changed; of the others ``spm_share`` percent have the suffix first. Cuts and form
    depend on ``seed``, the id and the number of units alone: rows of one id are cut alike, at equal
    units if their texts are equal, and a null id counts as an empty one. An empty table gives no rows;
    columns of the new names are replaced. Texts of any length are matched whole, one at a time.
    """
    new = ("n", "form", "prefix_chars", "middle_chars", "output")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    source = docs.select(F.struct(*[F.col(c) for c in keep] or [F.lit(0).alias("none")]).alias("_row"), key.alias("_key"), F.col(text_col).cast("string").alias("_text"))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, start, held = [], 0, 0
            for at, (k, text) in enumerate(zip(batch.column(1), batch.column(2))):
                found.append(cut(text.as_py() or "", k.as_py(), rate, spm_share))
                held += len(found[-1][-1])
                if held >= _SLICE_BYTES or at == len(batch) - 1:
                    columns = [pa.array(values, kind) for values, kind in zip(zip(*found), kinds)]
                    columns[-1] = columns[-1].cast(pa.string())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(found)), *columns], names=["_row", *new])
                    found, start, held = [], at + 1, 0

    types = (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType())
    schema = T.StructType([source.schema["_row"], *[T.StructField(name, kind) for name, kind in zip(new, types)]])
    return source.mapInArrow(run, schema).select(*[F.col("_row")[c].alias(c) for c in keep], *new)


def restored(output: Column, form: Column) -> Column:
    """The exact text again, from the output of ``fill_in_middle`` and its form; null if the output is not of the form."""
    quoted = "|".join(map(regex.escape, _MARKS))
    parts = F.split(output, quoted)  # before the first mark there is nothing, and a text with a mark in it is plain
    whole = lambda *order: F.when(F.size(parts) == 4, F.concat(*[parts[i] for i in order]))
    return F.when(form == "plain", output).when(form == "psm", whole(1, 3, 2)).when(form == "spm", whole(2, 3, 1))


#: For the standard parameters: seed 7, every text, half of them with the suffix first.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), l AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d
), c AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM l
), p AS (
  SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
