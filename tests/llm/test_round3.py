"""Hard negatives, approximate neighbours and fill-in-middle against brute force and exact round trips."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from countstats.llm import fim, hnsw, language, mixing, negatives, queries, sharding

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
VECTORS = "vec_id bigint, embedding array<double>, label int"
EXTRA = ("id", "row", "v", "dim", "n", "form", "output", "rank", "score", "block", "part", "node", "shard", "_row", "_key", "_text", "_")


def clean(made):
    return [(i, v, label) for i, v, label in made if v is not None and all(x is not None and np.isfinite(x) for x in v)]


def by_id(i):
    return (i is None, i or 0)


# 11 --------------------------------------------------------------------------------------------


def brute_negatives(made, positives=5, negatives_=10, low=30, high=90, scale=256, every=10):
    rows = [(i, [int(np.floor(scale * x)) for x in v], label) for i, v, label in clean(made) if label is not None]
    out = []
    for a, (i, v, label) in enumerate(rows):
        if i is None or i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), by_id(j), b, j, other) for b, (j, w, other) in enumerate(rows) if a != b and len(v) == len(w))
        for s, _, _, j, _ in [x for x in scored if x[-1] == label][:positives]:
            own = [x for x in scored if x[-1] != label and low * -s <= 100 * -x[0] <= high * -s][:negatives_]
            out += [(i, j, r + 1, x[3], -s, -x[0]) for r, x in enumerate(own)]
    return out


def odd_vectors(rng):
    made = [(i, rng.normal(size=4).round(2).tolist(), int(rng.integers(0, 4))) for i in range(150)]
    made += [(200 + i, [0.5, 0.5, -0.5, 1.0], i % 3) for i in range(60)]  # copies of all labels
    made += [(500, None, 1), (510, [1.0, None, 1.0, 1.0], 1), (520, [float("nan")] * 4, 1), (530, [float("inf")] * 4, 1), (540, [1.0] * 4, None)]
    made += [(None, [0.4, 0.4, 0.4, 0.4], 1), (None, [0.4, 0.4, 0.4, 0.4], 2), (10, made[10][1], made[10][2]), (550, [1.0, 2.0], 1), (560, [0.5, 2.0], 1), (561, [0.4, 1.0], 2), (570, [], 1), (571, [], 1), (572, [], 2), (580, [0.0] * 4, 1)]
    return made


@pytest.mark.parametrize("numbers", [1 << 20, 160])
def test_hard_negatives_by_brute_force(spark, monkeypatch, numbers):
    monkeypatch.setattr(negatives, "BLOCK_NUMBERS", numbers)
    monkeypatch.setattr(negatives, "FIRST_READ", 4)
    made = odd_vectors(np.random.default_rng(numbers))
    frame = spark.createDataFrame(made, VECTORS).withColumns({c: F.lit("x") for c in EXTRA})
    got = [tuple(r) for r in negatives.mine(frame, F.col("id") % 10 == 0).collect()]
    assert Counter(got) == Counter(brute_negatives(made))
    assert negatives.mine(frame.limit(0), F.col("id") % 10 == 0).count() == 0
    assert negatives.mine(frame.filter("vec_id = 10"), F.lit(False)).count() == 0


def test_hard_negatives_where_every_row_has_a_label_of_its_own_or_all_have_one(spark):
    rng = np.random.default_rng(2)
    for label in (lambda i: i, lambda i: 7):
        made = [(i, rng.normal(size=3).tolist(), label(i)) for i in range(40)]
        assert negatives.mine(spark.createDataFrame(made, VECTORS), F.col("id") % 10 == 0).count() == 0  # no positives, or no negatives


def test_threshold_search_reads_less_where_one_component_leads():
    rng = np.random.default_rng(3)
    points = np.floor(256 * np.column_stack([rng.standard_t(2, 20_000), rng.normal(0, 0.05, (20_000, 3))]))
    lists, ids = negatives.Lists(points, np.zeros(len(points), np.int32)), np.arange(len(points))
    anchor, everything = np.array([200.0, 3.0, -2.0, 1.0]), np.ones(len(points), dtype=bool)
    score = (points @ anchor).astype(np.int64)
    order = np.lexsort((ids, -score))
    (place, found), = negatives.threshold_search(lists, anchor, everything, [(None, None)], 10, ids)
    assert place.tolist() == order[:10].tolist() and lists.accessed < 4000
    low, high = int(score[order[40]]), int(score[order[20]])
    (place, found), = negatives.threshold_search(lists, anchor, everything, [(low, high)], 5, ids)
    assert place.tolist() == [p for p in order if low <= score[p] <= high][:5]
    (place, _), = negatives.threshold_search(lists, np.zeros(4), everything, [(None, None)], 3, ids)
    assert place.tolist() == [0, 1, 2]
    huge = negatives.Lists(np.full((3, 2), 2.0**40), np.zeros(3, np.int32))
    with pytest.raises(ValueError, match="beyond"):
        negatives.threshold_search(huge, np.full(2, 2.0**40), np.ones(3, dtype=bool), [(None, None)], 1, np.arange(3))
    exact = negatives.Lists(np.array([[2.0**30, 1.0], [2.0**30, 3.0]]), np.zeros(2, np.int32))
    assert exact.scores(np.array([2.0**30, 1.0]), np.arange(2)).tolist() == [2**60 + 1, 2**60 + 3]


# 12 --------------------------------------------------------------------------------------------


def brute_nearest(points, ids, queries_, k):
    scores = points[queries_] @ points.T
    scores[np.arange(len(queries_)), queries_] = -np.inf
    return {ids[q]: set(np.array(ids)[np.argsort(-s, kind="stable")[:k]].tolist()) for q, s in zip(queries_, scores)}


@pytest.mark.parametrize("kind", ["even", "clusters", "lengths"])
def test_recall_of_neighbours(spark, kind):
    rng = np.random.default_rng(4)
    n, dim = 4000, 24
    points = rng.normal(size=(n, dim))
    if kind == "clusters":
        points = rng.normal(size=(40, dim))[rng.integers(0, 40, n)] + 0.05 * points
    if kind == "lengths":
        points *= np.exp(rng.normal(0, 1, (n, 1)))
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id bigint, embedding array<double>")
    found = hnsw.nearest(frame, F.col("id") % 20 == 0, k=20, shard_rows=1500, query_block=64).collect()
    truth = brute_nearest(points, list(range(n)), np.arange(0, n, 20), 20)
    got = {}
    for r in found:
        got.setdefault(r["query_id"], {})[r["rank"]] = r
        assert r["score"] == pytest.approx(points[r["query_id"]] @ points[r["vec_id"]], rel=1e-12)
    assert set(got) == set(truth) and all(sorted(g) == list(range(1, 21)) for g in got.values())
    for g in got.values():
        assert [g[i]["score"] for i in range(1, 21)] == sorted((x["score"] for x in g.values()), reverse=True)
    assert np.mean([len(truth[q] & {r["vec_id"] for r in g.values()}) / 20 for q, g in got.items()]) > 0.95


def test_neighbours_of_odd_rows_are_those_of_brute_force(spark):
    made = [(i, v) for i, v, _ in odd_vectors(np.random.default_rng(5))]
    frame = spark.createDataFrame(made, "vec_id bigint, embedding array<double>").withColumns({c: F.lit("x") for c in EXTRA})
    got = [tuple(r) for r in hnsw.nearest(frame, F.col("id") % 10 == 0, k=20, ef=300, shard_rows=64, query_block=16).collect()]
    rows = [(i, v) for i, v, _ in clean((i, v, 0) for i, v in made) if any(v)]
    want = []
    for a, (i, v) in enumerate(rows):
        if i is not None and i % 10 == 0:
            score = lambda w, v=v: reduce(lambda s, xy: s + xy[0] * xy[1], zip(v, w), 0.0)  # noqa: E731  one after the other
            found = sorted((-score(w), by_id(j), b, j) for b, (j, w) in enumerate(rows) if a != b and len(v) == len(w))[:20]
            want += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(found)]
    assert Counter(got) == Counter(want)  # few distinct vectors: every one of them is met
    assert hnsw.nearest(frame.limit(0), F.col("id") % 10 == 0).count() == 0


def test_graph_is_flat_and_its_layers_shrink():
    points = hnsw.lifted(np.random.default_rng(6).normal(size=(1000, 8)))
    assert np.allclose((points * points).sum(axis=1), 1, atol=1e-5)
    graph = hnsw.build(points, links=8)
    assert [len(x) for x in graph.layers] == [1000, 125, 16, 2] and [x.shape[1] for x in graph.layers] == [16, 8, 8, 8]
    for layer in graph.layers:
        assert layer.max() < len(layer) and not (layer == np.arange(len(layer))[:, None]).any()
        for row in layer:
            assert len(set(row[row >= 0])) == (row >= 0).sum()
        reached, new = {0}, {0}
        while new:  # every point is reached from the first
            new = {int(x) for i in new for x in layer[i] if x >= 0} - reached
            reached |= new
        assert len(reached) == len(layer)


# 13 --------------------------------------------------------------------------------------------


def brute_cut(text, key, rate, share):
    h = [int(hashlib.sha256(key.encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return len(units), *(("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < share else ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"))


TEXTS = [None, "", "\n", "\n\n\n", "a", "a\nb", "a\nb\n", "\U0001f600é\n\tzwei\n\nend", "has <P> in it\nx", "<S>", "a<M>", "near <P\n> <\nS>", "\r\nx\r\n", "word " * 200_000, "l\n" * 100_000, "<\n<\nP>\n<S"]


@pytest.mark.parametrize("rate,share", [(100, 50), (60, 0), (100, 100), (0, 50)])
def test_fill_in_middle_by_brute_force(spark, rate, share):
    made = [(i, t, "en", "a", 1) for i, t in enumerate(TEXTS)] + [(None, "x\ny\nz", "en", "a", 1), (3, TEXTS[3], "en", "a", 1), (-5, "x\ny\nz\n", "en", "a", 1)]
    frame = spark.createDataFrame(made, DOCS).withColumns({c: F.lit("x") for c in EXTRA})
    found = fim.fill_in_middle(frame, seed=9, rate=rate, spm_share=share)
    assert set(found.columns) == set(frame.columns) | {"n", "form", "prefix_chars", "middle_chars", "output"} and len(found.columns) == len(set(found.columns))
    got = found.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(made)
    want = Counter((i, brute_cut(t or "", f"9:{'' if i is None else i}", rate, share)) for i, t, *_ in made)
    assert Counter((r["doc_id"], (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])) for r in got) == want
    assert all(r["back"] == (r["text"] or "") and r["score"] == "x" for r in got)
    assert fim.fill_in_middle(frame.limit(0)).count() == 0


def test_a_very_long_text_is_cut_and_restored(spark):
    frame = spark.range(4).select(F.col("id").alias("doc_id"), F.repeat(F.lit("twenty characters..\n"), 1_000_000).alias("text"))
    found = fim.fill_in_middle(frame, keep=["doc_id"])
    assert [r["same"] for r in found.join(frame, "doc_id").select((fim.restored(F.col("output"), F.col("form")) == F.col("text")).alias("same")).collect()] == [True] * 4


def test_recall_of_the_query(spark, sf_dir):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect() if r["embedding"] is not None and any(r["embedding"])]
    points, ids = np.array([v for _, v in vectors]), [i for i, _ in vectors]
    truth = brute_nearest(points, ids, np.flatnonzero(np.array(ids) % 20 == 0), 20)
    got = {}
    for r in queries.op12_nearest(spark, sf_dir).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(truth[q] & got[q]) / len(truth[q]) for q in truth]) >= 0.9


# Hot keys and long texts of the earlier operators -------------------------------------------------


def test_a_third_of_all_rows_alike_is_sharded_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HOT_ROWS", 20)
    made = [(None if i % 3 == 0 else i, "same" if i % 3 == 0 else f"text {i}", "en", "a", 1) for i in range(300)]
    frame = spark.createDataFrame(made, DOCS)
    got = sharding.assign_shards(frame, shards=7).collect()
    assert Counter(r["shard"] for r in got) == Counter(i % 7 for i in range(300))
    assert sorted((r["shard"], r["slot"]) for r in got) == sorted((i % 7, i // 7) for i in range(300))
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(m[:2] for m in made)


def test_rows_of_one_id_are_mixed_by_their_texts(spark):
    made = [(None, f"w{i} x{i} y{i}", "en", "a", 1) for i in range(400)] + [(7, "four words are here", "en", "b", 1)] * 50
    frame = spark.createDataFrame(made, DOCS)
    report = mixing.mix_report(frame, seed=3).collect()
    assert len(report) == 450 and all(0 <= r["taken"] <= 3 * r["size"] for r in report)
    for source, size in ((1200, 1200), (200, 200)):
        own = [r for r in report if r["source_size"] == size]
        assert sum(r["taken"] for r in own) == pytest.approx(own[0]["target"], rel=0.02)
    mixed = mixing.mix(frame, seed=3)
    assert mixed.select(F.sum(F.size(F.split("text", r"\s+")))).first()[0] == sum(r["taken"] for r in report)


def test_a_model_too_large_for_the_driver_is_refused(spark, monkeypatch):
    monkeypatch.setattr(language, "MODEL_ROWS", 3000)
    word = lambda i: "".join(chr(97 + int(c, 16)) for c in hashlib.sha256(str(i).encode()).hexdigest()[:8])
    frame = spark.createDataFrame([(i, " ".join([word(3 * i + k) for k in range(3)] * 2), f"l{i % 5}", "a", 1) for i in range(2000)], DOCS)
    with pytest.raises(ValueError, match="languages"):
        language.learn(frame)
    monkeypatch.setattr(language, "MODEL_ROWS", 5000)
    with pytest.raises(ValueError, match="frequencies"):
        language.learn(frame)


# The pipeline on odd tables ------------------------------------------------------------------------


def words(seed, n):
    return " ".join("".join(np.random.default_rng((seed, i)).choice(list("abcdefghij"), 7)) for i in range(n))


BASE = [(i, words(i, 60), "en" if i % 2 else "de", f"s{i % 3}", 480) for i in range(40)]


@pytest.mark.parametrize("kind", ["empty", "nulls", "no benchmark", "repeated and clashing", "one text for all"])
def test_pipeline_of_odd_tables(spark, tmp_path, kind):
    import corpus_pipeline

    rows = {"empty": [], "nulls": [(i, None, None, None, None) for i in range(5)], "one text for all": [(i, words(1, 60), "en", "s", 480) for i in range(30)]}.get(kind, BASE)
    rows = rows + BASE[:10] + [(None, None, None, None, None), (100, "", "en", "s1", 0)] if kind.startswith("repeated") else rows
    docs = spark.createDataFrame(rows, DOCS)
    if kind.startswith("repeated"):
        docs = docs.withColumns({c: F.lit("x") for c in (*EXTRA, "label", "key", "first", "set", "fp", "a", "b", "_doc", "_row", "_bucket", "size", "lang_pred")})
    items = [] if kind == "no benchmark" else [(1, " ".join(BASE[3][1].split()[5:30]))]
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}")
    got = out.collect()
    assert set(docs.columns) - {"size"} <= set(out.columns)
    left = {r["doc_id"] for r in got}
    want = {"empty": set(), "nulls": set(), "one text for all": {0}, "no benchmark": set(range(40))}.get(kind, set(range(40)) - {3})
    assert left <= want and len(left) >= 0.5 * len(want)  # the mix takes no words of some, as sources are brought to weights
    counts = Counter(r["shard"] for r in got)
    assert not got or max(counts.values()) - min(counts[i] for i in range(40)) <= 1
