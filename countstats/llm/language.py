"""Language ID by word-first backoff: log frequencies of known words, else of ever shorter character n-grams."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import materialize

UNKNOWN = "und"
#: Most frequencies of words, and of n-grams, that a model may have: what the driver and each worker hold.
MODEL_ROWS = 5_000_000
LONGEST_GRAM = 4
#: A worker forgets words when their scores are so many numbers; they are then worked out anew.
CACHED_NUMBERS = 200_000
#: A table of at most so many numbers is laid out in full by a worker.
DENSE_NUMBERS = 16_000_000
#: Rows that are turned into Python objects at once.
_SLICE = 512
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of the word between its two boundary marks."""
    marked = f"\x02{word}\x03"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class LogTable:
    """Log frequencies by language for each key. A language without a count of the key has the log of
    its smoothing share, ``floor``; the others are listed, so that the table grows with what was
    counted and not with the number of languages."""

    index: dict[str, int]
    starts: np.ndarray
    language: np.ndarray
    log: np.ndarray
    floor: np.ndarray

    @classmethod
    def of(cls, counts: pd.DataFrame, languages: list[str], totals: dict[str, int]) -> LogTable:
        """From (lang, key, n), smoothed by half an occurrence for each key."""
        keys, row = np.unique(counts["key"].to_numpy(dtype=object), return_inverse=True) if len(counts) else (np.zeros(0, object), np.zeros(0, np.int64))
        sizes = np.array([totals.get(language, 0) + 0.5 * max(1, len(keys)) for language in languages])
        column = counts["lang"].map({language: i for i, language in enumerate(languages)}).to_numpy(dtype=np.int64)
        order = np.lexsort((column, row))
        row, column = row[order], column[order]
        log = np.log(counts["n"].to_numpy(dtype=float)[order] + 0.5) - np.log(sizes)[column]
        return cls({k: i for i, k in enumerate(keys)}, np.searchsorted(row, np.arange(len(keys) + 1)), column, log, np.log(0.5) - np.log(sizes))

    @cached_property
    def dense(self) -> np.ndarray | None:
        if len(self.index) * len(self.floor) > DENSE_NUMBERS:
            return None
        out = np.tile(self.floor, (len(self.index), 1))
        out[np.repeat(np.arange(len(self.index)), np.diff(self.starts)), self.language] = self.log
        return out

    def row(self, at: int) -> np.ndarray:
        """A log frequency for each language."""
        if self.dense is not None:
            return self.dense[at]
        out, span = self.floor.copy(), slice(self.starts[at], self.starts[at + 1])
        out[self.language[span]] = self.log[span]
        return out

    def mean(self, rows: list[int]) -> np.ndarray:
        return (self.dense[rows].sum(axis=0) if self.dense is not None else sum(map(self.row, rows))) / len(rows)


@dataclass(frozen=True)
class LanguageModel:
    """``grams`` has a table for each length of n-gram, from 1 on."""

    languages: list[str]
    words: LogTable | None = None
    grams: tuple[LogTable, ...] = ()

    def score(self, word: str) -> np.ndarray:
        """A known word's log frequencies. Of an unseen word: the mean of its longest known n-grams;
        nothing known says nothing."""
        at = self.words.index.get(word)
        if at is not None:
            return self.words.row(at)
        for n in range(len(self.grams), 0, -1):
            table = self.grams[n - 1]
            known = [at for g in grams_of(word, n) if (at := table.index.get(g)) is not None]
            if known:
                return table.mean(known)
        return np.zeros(len(self.languages))


class _Scorer(dict):
    """What lies between white space -> row of ``logs``: the sum over the words in it. Row 0 is of what
    has no word; known words have the rows after it, if their table is laid out in full."""

    def __init__(self, model: LanguageModel):
        super().__init__()
        n = len(model.languages)
        self.model, self.most = model, max(1024, CACHED_NUMBERS // max(1, n))
        known = model.words.dense if model.languages else None
        self.known = model.words.index if known is not None else {}
        self.logs = np.concatenate([np.zeros((1, n)), known if known is not None else np.zeros((0, n)), np.zeros((1024, n))])
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.seen: dict[str, int] = {}
        self.used = self.first = 1 + len(self.known)

    def _add(self, words: list[str]) -> int:
        row = self.used
        if row == len(self.logs):
            self.logs = np.concatenate([self.logs, np.zeros((len(self.logs) - self.first + 1024, self.logs.shape[1]))])
        self.logs[row] = sum(map(self.model.score, words))
        self.used += 1
        return row

    def __missing__(self, piece: str) -> int:
        words = words_of(piece)
        if not words:
            row = 0
        elif len(words) > 1:
            row = self._add(words)
        elif (at := self.known.get(words[0])) is not None:
            row = at + 1
        elif (row := self.seen.get(words[0])) is None:
            row = self.seen[words[0]] = self._add(words)
        self[piece] = row
        return row

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.model.languages:
            return UNKNOWN, 0.0
        sums, found, pieces = np.zeros(len(self.model.languages)), False, text.split()
        for at in range(0, len(pieces), 4096):
            if self.used - self.first > self.most or len(self) > 2 * self.most:
                self._forget()
            part = pieces[at : at + 4096]
            rows = np.fromiter(map(self.__getitem__, part), dtype=np.int64, count=len(part))
            found = found or bool(rows.any())
            sums += self.logs[rows].sum(axis=0)
        if not found:
            return UNKNOWN, 0.0
        best = int(np.argmax(sums))  # of a tie the first, languages being sorted
        return self.model.languages[best], float(1.0 / np.exp(sums - sums[best]).sum())


def held_out(doc_id: Column) -> Column:
    """True for a third of all ids, which training must not see; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: dict[str, Counter] = {}
        for language, text in zip(batch["lang"], batch["text"]):
            counts.setdefault(language, Counter()).update(words_of(text))
        rows = [(language, word, n) for language, c in counts.items() for word, n in c.items()]
        yield pd.DataFrame(rows, columns=["lang", "key", "n"])


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: Counter = Counter()
        for language, word, n in zip(batch["lang"], batch["key"], batch["n"]):
            for size in range(1, LONGEST_GRAM + 1):
                for gram in grams_of(word, size):
                    counts[language, size, gram] += n
        rows = [(*key, n) for key, n in counts.items()]
        yield pd.DataFrame(rows, columns=["lang", "size", "key", "n"])


def _most_frequent(counts: DataFrame, by: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "key")
    return counts.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= most).drop("_rank")


def _bounded(counts: DataFrame) -> pd.DataFrame:
    counts = materialize(counts)
    if (n := counts.count()) > MODEL_ROWS:
        raise ValueError(f"a model of {n} frequencies would not fit the driver; lower max_words or max_grams")
    return counts.toPandas()


def learn(docs: DataFrame, per_language: int = 4000, max_words: int = 40_000, max_grams: int = 5_000) -> LanguageModel:
    """Learn from the rows of ``docs`` whose text and lang are not null; every value of lang is learned.

    The model is fitted on a bounded sample: of each language about ``per_language`` distinct texts,
    chosen by a hash, each as a whole and once, however many copies it has. Of each language the model
    holds the ``max_words`` most frequent words and the ``max_grams`` most frequent n-grams of each
    length; rarer words are scored by backoff like any unseen one. Languages do not share these
    limits, so one more language takes nothing from the others. Without labelled rows the model is empty.
    A word that stands once in the whole sample is no known word. The model passes through the driver
    to all tasks; one of more than MODEL_ROWS frequencies, or of more than a thousandth as many languages, is an error.
    """
    labelled = docs.select("text", F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("hash")).filter("text is not null and lang is not null")
    sizes = labelled.groupBy("lang", "hash").count().groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MODEL_ROWS // 1000 + 1).collect()
    if len(sizes) > MODEL_ROWS // 1000:
        raise ValueError(f"more than {MODEL_ROWS // 1000} languages: the model would not fit the driver")
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return LanguageModel([])
    rate = F.broadcast(docs.sparkSession.createDataFrame([(r["lang"], min(1.0, per_language / r["n"])) for r in sizes], "lang string, rate double"))  # the model has a column for each of these rows
    draw = F.pmod(F.xxhash64(F.col("hash"), F.lit("sample")), F.lit(1_000_003)) / 1_000_003.0
    sample = labelled.join(rate, "lang").filter(draw < F.col("rate")).dropDuplicates(["lang", "hash"]).select("lang", "text")
    words = sample.mapInPandas(_count_words, "lang string, key string, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    words = materialize(words)
    totals = {(r["lang"], 0): r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    repeated = words.join(words.groupBy("key").agg(F.sum("n").alias("all")).filter("all > 1").select("key"), "key", "left_semi")
    kept = _bounded(_most_frequent(repeated, ["lang"], max_words))
    grams = materialize(words.mapInPandas(_count_grams, "lang string, size int, key string, n bigint").groupBy("lang", "size", "key").agg(F.sum("n").alias("n")))
    totals |= {(r["lang"], r["size"]): r["n"] for r in grams.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()}
    most = _bounded(_most_frequent(grams, ["lang", "size"], max_grams))
    of_size = lambda size: {language: totals.get((language, size), 0) for language in languages}
    tables = tuple(LogTable.of(most[most["size"] == size], languages, of_size(size)) for size in range(1, LONGEST_GRAM + 1))
    return LanguageModel(languages, LogTable.of(kept, languages, of_size(0)), tables)


def predict(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None, min_score: float | None = None) -> DataFrame:
    """``keep`` (all columns by default) with lang_pred and score for every row.

    The whole text is scored. lang_pred is ``und``, with score 0, if the text is null or has no
    letter or the model is empty; score is the posterior of the language under equal priors, ties
    going to the language first in code-point order. Columns named lang_pred or score are replaced.
    With ``min_score`` only rows stay that have a language and at least that score.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    row = F.struct(*[F.col(c) for c in keep]).alias("_row")
    inside = keep.index("text") if "text" in keep else None  # the text travels once
    source = docs.select(row) if inside is not None else docs.select(row, F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in batches:
            for start in range(0, len(batch), _SLICE):
                part = batch.slice(start, _SLICE)
                texts = part.column(0).field(inside) if inside is not None else part.column(1)
                found = [scorer.predict(text.as_py()) for text in texts]
                out = pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["_row", "lang_pred", "score"])
                if min_score is not None:
                    out = out.filter(pa.array([x != UNKNOWN and s >= min_score for x, s in found], pa.bool_()))
                yield out
            pa.default_memory_pool().release_unused()

    schema = T.StructType([source.schema["_row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return source.mapInArrow(run, schema).select("_row.*", "lang_pred", "score")
