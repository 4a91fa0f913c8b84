"""Quality by co-training: a text view and a metadata view teach each other confident pseudo-labels."""

from __future__ import annotations

import string
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import materialize, remove_folder, shared_folder
from .common import by_bytes

_SPACE, _ENDS = b" \t\n\r\x0b\x0c", b".,!?#$%&*|"
_CLASSES = [string.ascii_uppercase.encode(), string.ascii_lowercase.encode(), string.digits.encode(), string.punctuation.encode(), _SPACE, bytes(range(128, 256)), b".,;:", b"!?", b"|#$%&*"]
#: Which bytes a class has, as a matrix; and for each byte whether it is of _ENDS (1), white space (2) or neither.
_IN_CLASS = np.array([[byte in c for byte in range(256)] for c in _CLASSES], dtype=np.int64)
_KINDS = bytes(1 if byte in _ENDS else 2 if byte in _SPACE else 0 for byte in range(256))
_SOURCES, _LANGUAGES = 32, 16
_STYLE = len(_CLASSES) + 9
#: Places that words, and that runs of three bytes, are hashed to.
WORD_PLACES, GRAM_PLACES = 256, 128
TEXT_FEATURES = _STYLE + WORD_PLACES + GRAM_PLACES
META_FEATURES = _SOURCES + _LANGUAGES + 3
#: Bytes of a text that become numbers of more bytes at once.
_BLOCK = 1 << 20
#: Features are stored in short floats; what is learned and scored is in long ones.
_STORED = np.float16


def _spread(counts: np.ndarray) -> np.ndarray:
    """Square roots of shares: long and short texts are alike, common places do not drown the others."""
    return np.sqrt(counts / max(1, counts.sum()))


def _bytes_of_class(data: bytes) -> np.ndarray:
    raw, found = np.frombuffer(data, dtype=np.uint8), np.zeros(256, dtype=np.int64)
    for at in range(0, len(raw), _BLOCK):
        found += np.bincount(raw[at : at + _BLOCK], minlength=256)
    return _IN_CLASS @ found


def _content(data: bytes, words: Counter) -> np.ndarray:
    """What the text is about: hashed words and hashed runs of three bytes, all of them."""
    places = np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words)) % WORD_PLACES
    by_word = np.bincount(places, weights=np.fromiter(words.values(), dtype=float, count=len(words)), minlength=WORD_PLACES)
    raw, by_gram = np.frombuffer(data, dtype=np.uint8), np.zeros(GRAM_PLACES)
    for at in range(0, len(raw) - 2, _BLOCK):
        x = raw[at : at + _BLOCK + 2].astype(np.uint32)
        mixed = (x[:-2] * np.uint32(40_503) + x[1:-1] * np.uint32(1_566_083) + x[2:] * np.uint32(69_069_069)) >> np.uint32(11)
        by_gram += np.bincount(mixed % np.uint32(GRAM_PLACES), minlength=GRAM_PLACES)
    return np.concatenate([_spread(by_word), _spread(by_gram)])


def text_features(text: str | None) -> np.ndarray:
    """Of the whole text: shares of character classes, of repeated words and lines, and its content. No Python
    code runs for each word: a corpus is mostly words, and every text is read twice, to learn and to score."""
    data = (text or "").encode("utf-8", "surrogatepass")
    lower, kinds = data.lower(), data.translate(_KINDS)
    words = lower.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    w, counts = max(1, len(words)), Counter(words)
    most = max(counts.values(), default=0) / w
    twice = sum(map(eq, words, islice(words, 1, None))) / w
    ended = (kinds.count(b"\x01\x02") + kinds.endswith(b"\x01")) / w  # words end at white space or with the text
    style = [*_bytes_of_class(data) / max(1, len(data)), np.log1p(len(words)), len(data) / w / 10, len(counts) / w, len(counts) / np.sqrt(w) / 10, most, twice, ended, len(set(lines)) / max(1, len(lines)), np.log1p(w / max(1, len(lines)))]
    return np.concatenate([style, _content(lower, counts)])


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> list[float]:
    """Hashed source and language, and the stated length; nulls have places of their own."""
    out = [0.0] * META_FEATURES
    out[0 if source is None else 1 + zlib.crc32(str(source).encode()) % (_SOURCES - 1)] = 1.0
    out[_SOURCES + (0 if lang is None else 1 + zlib.crc32(str(lang).encode()) % (_LANGUAGES - 1))] = 1.0
    size = np.log1p(max(0, n_chars or 0))
    out[-3:] = [float(n_chars is None), size / 10, size * size / 100]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Weights and intercept of a ridge logistic regression by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    weights, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        p = _sigmoid(x @ weights)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (p - y) + penalty * weights)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return weights


@dataclass(frozen=True)
class View:
    """A standardised logistic regression, and the line that calibrates its logit."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> View:
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale = np.where(scale > 1e-9, scale, 1.0)
        return cls(mean, scale, _fit((x - mean) / scale, y, ridge))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(x) + self.offset

    def calibrated(self, x: np.ndarray, y: np.ndarray) -> View:
        """By a logistic regression of held-back labels on the logit."""
        if len(set(y.tolist())) < 2:
            return self
        slope, offset = _fit(self.raw(x)[:, None], y, 1e-3)
        return View(self.mean, self.scale, self.weights, float(max(slope, 0.0)), float(offset))


@dataclass(frozen=True)
class QualityModel:
    prior: float  # logit
    text: View | None = None
    meta: View | None = None


def _raw_logits(batches: Iterator[pa.RecordBatch], views: tuple[View, View]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = [v.raw(np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=_STORED).reshape(len(batch), -1).astype(float)) for v, c in zip(views, ("text", "meta"))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), *map(pa.array, both)], names=["id", "digest", "text_logit", "meta_logit"])


def _matrices(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(b"".join(rows[c]), dtype=_STORED).reshape(len(rows), n).astype(float) for c, n in (("text", TEXT_FEATURES), ("meta", META_FEATURES)))


def co_train(labelled: pd.DataFrame, pool: DataFrame, marked: DataFrame, rounds: int = 4, share: float = 0.05, confident: float = 0.95, teach: int = 2000) -> QualityModel:
    """``labelled`` (digest, quality, text, meta: features as bytes) is on the driver, ``pool`` (id, digest, text, meta)
    holds the features of all texts, of which those are unlabelled whose id is not in ``marked`` (id). In each round both views are fitted and score the whole
    pool; each gives its surest rows (see ``_limits``) to the other view as pseudo-labels, of each
    class ``teach`` texts at most, drawn among them by a hash. A fifth of the labelled, by digest, is held back and
    calibrates the views. With labels of one class or none the model is the prior alone."""
    labels, held_back = labelled["quality"].to_numpy(dtype=float), labelled["digest"].to_numpy() % 5 == 0
    share_good = float(labels.mean()) if len(labels) else 0.5
    prior = float(np.log(np.clip(share_good, 1e-3, 1 - 1e-3) / (1 - np.clip(share_good, 1e-3, 1 - 1e-3))))
    if len(set(labels[~held_back].tolist())) < 2:
        return QualityModel(prior)
    features = _matrices(labelled)
    fit = [(x[~held_back], labels[~held_back]) for x in features]
    known: list[set[int]] = [set(), set()]
    for turn in range(rounds + 1):
        views = tuple(View.fit(x, y) for x, y in fit)
        if turn == rounds:
            break
        schema = T.StructType([pool.schema["id"], *[T.StructField(c, k) for c, k in (("digest", T.LongType()), ("text_logit", T.DoubleType()), ("meta_logit", T.DoubleType()))]])
        logits = pool.mapInArrow(lambda batches, v=views: _raw_logits(batches, v), schema)
        logits = materialize(logits.join(marked, "id", "left_anti").drop("id"))  # narrow rows: the texts are not shuffled
        for own, other in ((0, 1), (1, 0)):
            logit = F.col(("text_logit", "meta_logit")[own])
            high, low = _limits(logits, logit, share_good, share, confident)
            taught = []
            for value, sure in ((1.0, logit >= high), (0.0, logit <= low)):
                drawn = logits.filter(sure).select("digest").distinct().orderBy(F.xxhash64("digest", F.lit(turn))).limit(teach + len(known[other]))
                new = [r["digest"] for r in drawn.collect() if r["digest"] not in known[other]][:teach]
                taught += [(d, value) for d in new]
            known[other] |= {d for d, _ in taught}
            if taught:
                wanted = F.broadcast(pool.sparkSession.createDataFrame(taught, "digest bigint, quality double"))  # 2 x teach rows at most
                rows = pool.join(wanted, "digest").groupBy("digest").agg(F.min("quality").alias("quality"), F.min("text").alias("text"), F.min("meta").alias("meta")).toPandas().sort_values("digest")
                x, y = fit[other]
                fit[other] = np.concatenate([x, _matrices(rows)[other]]), np.concatenate([y, rows["quality"].to_numpy()])
    return QualityModel(prior, *(v.calibrated(x[held_back], labels[held_back]) for v, x in zip(views, features)))


def _limits(logits: DataFrame, logit: Column, share_good: float, share: float, confident: float) -> tuple[float, float]:
    """The logits from which on, and up to which, rows are taught as good and as bad: the surest ``share`` of
    the pool, dealt to both by class prior, and only those that are sure to ``confident``."""
    sure = float(np.log(confident / (1 - confident)))
    ends = [share * (1 - share_good), 1 - share * share_good]
    low, high = logits.agg(F.percentile_approx(logit, F.array(*[F.lit(e) for e in ends]), F.lit(100_000)).alias("q")).first()["q"] or (-np.inf, np.inf)
    return max(sure, high), min(-sure, low)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features as bytes of short floats."""
    for whole in batches:
        for batch in by_bytes(whole, 0):
            text, source, lang, n_chars = (batch.column(i).to_pylist() for i in range(4))
            texts = [np.minimum(text_features(t), 60_000.0).astype(_STORED).tobytes() for t in text]
            metas = [np.array(meta_features(*m), dtype=_STORED).tobytes() for m in zip(source, lang, n_chars)]
            yield pa.RecordBatch.from_arrays([*batch.columns[4:], pa.array(texts, pa.binary()), pa.array(metas, pa.binary())], names=[*batch.schema.names[4:], "text", "meta"])


def _views() -> list[Column]:
    return [F.col("text").cast("string"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long")]


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 5000, **options) -> QualityModel:
    """Co-train on a bounded sample of labelled texts, about ``per_class`` of either quality, chosen by a hash of
    id and text, and on all unlabelled ones; the features of all texts are written once to the shared folder.
    A labelled text that stands on many rows of one id is drawn once at most, with its least source,
    language and length; each text of an id that has many is drawn on its own. A document labelled
    twice has the lower label; null labels don't count. Rows without doc_id are not learned from."""
    spark = docs.sparkSession
    marks = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("double").alias("quality"))
    digest = F.xxhash64("doc_id", "text").alias("digest")
    marked = docs.filter("doc_id is not null").select("doc_id", digest).distinct().join(marks, "doc_id")
    keys = materialize(marked.select("digest", "quality"))
    sizes = {r["quality"]: r["n"] for r in keys.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    rate = F.lit(0.0)
    for value, n in sizes.items():
        rate = F.when(F.col("quality") == value, min(1.0, per_class / n)).otherwise(rate)
    draw = F.pmod(F.xxhash64("digest", F.lit("quality")), F.lit(1_000_003)) / 1_000_003.0
    sample = F.broadcast(keys.filter(draw < rate))  # bounded by per_class
    seen = docs.filter("doc_id is not null").select("doc_id", digest, *[c.alias(f"_{i}") for i, c in enumerate(_views())])
    views = F.struct(*[f"_{i}" for i in range(4)])
    drawn = seen.join(sample, "digest").groupBy("digest").agg(F.min(views).alias("views"), F.min("quality").alias("quality"))
    labelled = drawn.select("views.*", "digest", "quality").mapInArrow(_feature_rows, "digest bigint, quality double, text binary, meta binary").toPandas().sort_values("digest", kind="stable")

    every = seen.select("_0", "_1", "_2", "_3", F.col("doc_id").alias("id"), "digest")
    schema = T.StructType([every.schema["id"], T.StructField("digest", T.LongType()), T.StructField("text", T.BinaryType()), T.StructField("meta", T.BinaryType())])
    folder = f"{shared_folder(spark)}/quality-{uuid.uuid4().hex}"
    try:
        every.mapInArrow(_feature_rows, schema).write.parquet(folder)
        return co_train(labelled, spark.read.parquet(folder), marks.select(F.col("doc_id").alias("id")), **options)
    finally:
        remove_folder(spark, folder)


def score(docs: DataFrame, model: QualityModel, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) with text_score, meta_score, quality_score for every row.

    The scores are probabilities of good quality: of either calibrated view, and of both, whose
    logits add up after taking the prior off once. A null or empty text has the features of no
    words, null metadata have features of their own. Existing columns of the new names are replaced.
    """
    new = ("text_score", "meta_score", "quality_score")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*[c.alias(f"_{i}") for i, c in enumerate(_views())], F.struct(*[F.col(c) for c in keep]).alias("_row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            n = len(batch)
            a = b = np.full(n, m.prior)
            if m.text is not None and n:
                a = m.text.logit(np.array([text_features(t.as_py()) for t in batch.column(0)]))
                b = m.meta.logit(np.array([meta_features(*x) for x in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))]))
            both = a + b - m.prior
            yield pa.RecordBatch.from_arrays([batch.column(4), *(pa.array(_sigmoid(x)) for x in (a, b, both))], names=["_row", *new])

    schema = T.StructType([source.schema["_row"], *(T.StructField(c, T.DoubleType()) for c in new)])
    return source.mapInArrow(run, schema).select("_row.*", *new)
