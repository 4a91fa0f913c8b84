"""The ten operators against brute force and SQL, with nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from countstats.llm import components, covertree, decontaminate, language, lines, mixing, quality, queries, sharding, simhash, substrings, tokens

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EXTRA = ("quality", "order", "size", "hash", "n", "window", "items", "spans", "fp", "label", "rank", "score", "_row", "_text", "id", "ref", "key", "a", "b")
RNG = np.random.default_rng(1)
WORDS = ["".join(RNG.choice(list("abcdefghijklmnop"), 6)) for _ in range(4000)]
LONG = " ".join(RNG.choice(WORDS, 5000))


def prose(seed, n=80):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


PASSAGE = prose(900, 60)
ROWS = [
    (1, prose(1), "en", "a", 1),
    (2, prose(1), "en", "b", 2),
    (3, f"{prose(3)}\n{PASSAGE}\n{prose(4)}", "en", None, None),
    (4, f"{prose(5)}\n{PASSAGE}\n{prose(6)}", "de", "a", 4),
    (5, None, None, "a", None),
    (6, "", "en", "\U0001f600", 0),
    (7, "  \n\t ", "en", "a", 5),
    (8, LONG, "en", "a", 9),
    (None, prose(8), "de", "c", 3),
    (9, prose(9), None, "c", 3),
    (9, prose(9), None, "c", 3),
    (10, "ünïcode Größe É word", "de", "c", 3),
]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, DOCS)
    return frame.withColumns({c: F.lit("x") for c in EXTRA})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


# 1 ---------------------------------------------------------------------------------------------


def test_token_counts_equal_an_independent_unigram_model(docs, empty, spark, sf_dir):
    from tokenizers import Tokenizer, models

    vocabulary = tokens.load_vocabulary()
    model = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary.scores.items()], 0, False))
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(40)
    for r in tokens.count_tokens(text, vocabulary).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"])
        assert r["n_words"] == len(words)
        assert r["n_tokens"] == sum(len(model.encode("▁" + w).ids) for w in words)
    found = {r["doc_id"]: r for r in tokens.count_tokens(docs, vocabulary).collect()}
    assert (found[5]["n_tokens"], found[6]["n_tokens"], found[7]["n_words"]) == (0, 0, 0)
    assert tokens.count_tokens(empty, vocabulary).count() == 0


def test_unknown_characters_fall_back_to_bytes_and_the_trie_may_be_emptied(monkeypatch):
    vocabulary = tokens.Vocabulary({"▁": -1.0, "ab": -2.0, "a": -2.0, "b": -2.0}, -30.0, 2)
    trie = tokens.TokenTrie(vocabulary)
    assert trie["▁abab"] == 3 and trie["▁a☃"] == 5
    monkeypatch.setattr(tokens, "MAX_NODES", 2)
    small = tokens.TokenTrie(vocabulary)
    for word in ("▁abab", "▁a☃", "▁bb", "▁abab"):
        assert small[word] == trie[word]


def test_a_word_of_millions_of_characters_needs_few_nodes(monkeypatch):
    from tokenizers import Tokenizer, models

    vocabulary = tokens.load_vocabulary()
    word = "▁" + "".join(np.random.default_rng(3).choice(list("abcdeftion"), 30_000))
    trie = tokens.TokenTrie(vocabulary)
    model = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary.scores.items()], 0, False))
    assert trie[word] == len(model.encode(word).ids) and len(trie.score) <= tokens.DEPTH + 1 and not trie
    monkeypatch.setattr(tokens, "DEPTH", 3)
    monkeypatch.setattr(tokens, "_HELD", 40)
    assert tokens.TokenTrie(vocabulary)[word] == trie[word]


# 2 ---------------------------------------------------------------------------------------------


def test_language_is_learned_from_two_thirds_and_right_on_the_rest(spark, sf_dir):
    found = queries.op2_language_id(spark, sf_dir)
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    joined = found.join(truth, "doc_id").filter("held_out and lang is not null").collect()
    assert len(joined) > 30
    assert np.mean([r["lang"] == r["lang_pred"] for r in joined]) > 0.97
    for r in found.collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1


def test_language_edges(docs, empty):
    model = language.learn(docs)
    found = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    assert [found[i]["lang_pred"] for i in (5, 6, 7)] == ["und"] * 3
    assert found[10]["lang_pred"] == "de" and found[10]["rank"] == "x"
    kept = language.predict(docs, model, min_score=0.5)
    assert {r["doc_id"] for r in kept.collect()} & {5, 6, 7} == set()
    nothing = language.learn(empty)
    assert {r["lang_pred"] for r in language.predict(docs, nothing).collect()} == {"und"}
    assert language.predict(empty, model).count() == 0


def naive_language(train, text):
    """Word-first backoff by definition, over whole dense tables."""
    languages = sorted({lang for lang, _ in train})
    counts = {k: {lang: Counter() for lang in languages} for k in range(5)}
    for lang, body in set(train):
        for w in language.words_of(body):
            counts[0][lang][w] += 1
            for k in range(1, 5):
                counts[k][lang].update(language.grams_of(w, k))
    known = {k: {x for c in counts[k].values() for x in c if k or sum(d[x] for d in counts[0].values()) > 1} for k in range(5)}
    log = lambda k, x: np.array([np.log(counts[k][lang][x] + 0.5) - np.log(counts[k][lang].total() + 0.5 * max(1, len(known[k]))) for lang in languages])
    sums, words = np.zeros(len(languages)), language.words_of(text)
    for w in words:
        if w in known[0]:
            sums += log(0, w)
            continue
        for k in range(4, 0, -1):
            logs = [log(k, g) for g in language.grams_of(w, k) if g in known[k]]
            if logs:
                sums += np.mean(logs, axis=0)
                break
    if not words:
        return "und", 0.0
    return languages[int(np.argmax(sums))], 1 / np.exp(sums - sums.max()).sum()


def test_language_by_brute_force(spark):
    rng = np.random.default_rng(12)
    vocabularies = {lang: ["".join(rng.choice(list(letters), rng.integers(2, 7))) for _ in range(30)] for lang, letters in (("aa", "abcdeé"), ("bb", "cdefgß"), ("cc", "fghijк"))}
    body = lambda lang: " ".join(rng.choice(vocabularies[lang], 12)) + ", 12-34!"
    train = [(lang, body(lang)) for lang in vocabularies for _ in range(20)] * 2
    asked = [body(lang) for lang in vocabularies for _ in range(10)] + ["zzz", "É-cab", "12 34", "", None, "½ ²", "Cdé_fgß"]
    model = language.learn(spark.createDataFrame([*train, ("aa", None), (None, "x")], "lang string, text string"))
    found = language.predict(spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "i int, text string"), model).collect()
    for r in found:
        lang, score = naive_language(train, asked[r["i"]])
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-9)


def test_many_languages_and_a_common_text(spark):
    names = [f"l{i:03}" for i in range(230)]
    word = lambda i: "".join(chr(97 + int(d)) for d in f"{i * 7919 % 1000003:06}")
    rows_ = [(n, f"{word(3 * i)} {word(3 * i + 1)} {word(3 * i + 2)} x{word(i)}") for i, n in enumerate(names) for _ in range(2)]
    model = language.learn(spark.createDataFrame(rows_, "lang string, text string"))
    assert model.languages == names
    found = language.predict(spark.createDataFrame([(n, t) for n, t in set(rows_)], "lang string, text string"), model).collect()
    assert all(r["lang"] == r["lang_pred"] for r in found)
    common = [("en", "hot text")] * 600 + [("en", f"text number{word(i)}") for i in range(300)]
    model = language.learn(spark.createDataFrame(common, "lang string, text string"), per_language=100)
    counted = sum(np.exp(model.words.log + np.log(0.5) - model.words.floor[0]) - 0.5)
    assert 60 < counted < 140 and "hot" not in model.words.index


# 3 ---------------------------------------------------------------------------------------------


def brute_contamination(text, items, n=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    words, hit, ids = split(text), set(), set()
    for item, body in items:
        w = split(body)
        for s in range(max(1, len(w) - n + 1) if w else 0):
            window = w[s : s + n]
            for at in range(len(words) - len(window) + 1):
                if words[at : at + len(window)] == window:
                    hit |= set(range(at, at + len(window)))
                    ids |= {str(item)} if item is not None else set()
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def test_contamination_by_brute_force(docs, empty, spark):
    w = PASSAGE.split()
    items = [(1, " ".join(w[5:30]).upper()), (2, " ".join(w[8:18])), (10, f"...{w[20]}, {w[21]}!"), (None, " ".join(w[40:52])), (3, None), (4, ""), (5, "É word"), (2, "größe")]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("n", F.lit("x"))
    found = decontaminate.contamination(docs, bench)
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in found.collect())
    assert got == Counter((r[0], *brute_contamination(r[1], items)) for r in ROWS)
    assert sum(n for k, n in got.items() if k[-1]) >= 3
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(ROWS) - sum(n for k, n in got.items() if k[-1])
    spans = decontaminate.decontaminate(docs, bench, remove="spans")
    assert spans.count() == len(ROWS) and not decontaminate.contamination(spans, bench.filter("item_id = 1")).filter("contaminated").count()
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination(docs, none).filter("contaminated").count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0


def test_contamination_without_a_broadcast(docs, spark, monkeypatch):
    w = PASSAGE.split()
    items = [(1, PASSAGE), (2, f"{w[3]} {w[4]}"), (3, " ".join(LONG.split()[4000:4030])), (None, "word")]
    more = spark.createDataFrame([(100 + i, f", {PASSAGE} {prose(100 + i, 3000)}" if i % 3 == 0 else PASSAGE) for i in range(60)], "doc_id bigint, text string")
    every = docs.unionByName(more, allowMissingColumns=True)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = rows(decontaminate.contamination(every, bench))
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_WINDOWS", 0)
    found = decontaminate.contamination(every, bench)
    assert rows(found) == want
    brute = Counter((r["doc_id"], *brute_contamination(r["text"], items)) for r in every.collect())
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in found.collect()) == brute


def test_contamination_keeps_columns_of_any_name(docs, spark, monkeypatch):
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string")
    keep = ("doc_id", "hash", "n", "items", "window", "spans", "_row", "_text", "key")
    for most in (1_000_000, 0):
        monkeypatch.setattr(decontaminate, "MAX_BROADCAST_WINDOWS", most)
        found = decontaminate.contamination(docs, bench, keep=keep)
        assert found.columns == [c for c in keep if c != "spans"] + ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]
        assert {r["hash"] for r in found.collect()} == {"x"} and found.filter("contaminated").count() == 2


# 4 ---------------------------------------------------------------------------------------------


def test_quality_is_learned(spark, sf_dir):
    scored = queries.op4_quality(spark, sf_dir)
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality is not null")
    found = scored.join(marks, "doc_id").collect()
    assert np.mean([(r["quality_score"] >= 0.5) == (r["quality"] == 1) for r in found]) > 0.95
    assert all(0 <= r[c] <= 1 for r in found for c in ("text_score", "meta_score", "quality_score"))


def test_quality_of_content_alone(spark):
    """Good and bad documents of one shape, that differ in their words; most are not labelled."""
    good, bad = WORDS[:150], WORDS[150:300]
    rng = np.random.default_rng(44)
    made = [(i, " ".join(rng.choice(good if i % 2 else bad, 60)), "en", f"s{(i % 2) if i % 5 else 2}", 400) for i in range(1600)]
    marks = [(i, i % 2, 0) for i in range(0, 1600, 8)] + [(i, i % 2, 0) for i in range(1, 1600, 8)]
    frame = spark.createDataFrame(made, DOCS)
    found = quality.score(frame, quality.learn(frame, spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int"))).collect()
    rest = [r for r in found if r["doc_id"] % 8 > 1]
    assert np.mean([(r["text_score"] >= 0.5) == (r["doc_id"] % 2 == 1) for r in rest]) > 0.97
    assert np.mean([(r["quality_score"] >= 0.5) == (r["doc_id"] % 2 == 1) for r in rest]) > 0.97


def test_quality_sample_is_bounded_if_one_id_has_very_many_rows(spark, monkeypatch):
    frame = spark.range(6000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 5000).alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(9).alias("n_chars"))
    seen = []
    monkeypatch.setattr(quality, "co_train", lambda labelled, pool, marked: seen.append((labelled["quality"].tolist(), pool.join(marked, "id", "left_anti").count())))
    quality.learn(frame, spark.createDataFrame([(1, 1, 0), (5000, 0, 0)], "doc_id bigint, quality int, toxic int"), per_class=100)
    assert 60 < sum(seen[0][0]) < 140 and seen[0][1] == 1999  # the pool is all that is not labelled
    same = frame.withColumn("text", F.lit("alike"))
    quality.learn(same, spark.createDataFrame([(1, 1, 0), (5000, 0, 0)], "doc_id bigint, quality int, toxic int"), per_class=100)
    assert sum(seen[1][0]) == 1


def test_quality_features_by_definition():
    text = "One two two é.\nThree"
    got, data = quality.text_features(text), text.encode().lower()
    words = Counter(data.split())
    want = np.zeros(quality.WORD_PLACES)
    for w, n in words.items():
        want[zlib.crc32(w) % quality.WORD_PLACES] += n
    at = len(got) - quality.WORD_PLACES - quality.GRAM_PLACES
    assert np.allclose(got[at : at + quality.WORD_PLACES], np.sqrt(want / want.sum()))
    assert np.isclose((got[at + quality.WORD_PLACES :] ** 2).sum(), 1) and len(got) == quality.TEXT_FEATURES
    assert len(quality.text_features(None)) == len(quality.text_features("a")) == quality.TEXT_FEATURES


def test_quality_edges(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    found = quality.score(docs, quality.learn(docs, none)).collect()
    assert len(found) == len(ROWS) and {r["quality_score"] for r in found} == {0.5}
    marks = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 0), (9, 1, 1), (None, 1, 0), (77, 0, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.learn(docs, marks)
    assert quality.score(docs, model).count() == len(ROWS) and quality.score(empty, model).count() == 0


def brute_co_training(labelled, pool, rounds, share, confident):
    """Co-training by definition, with numpy over whole arrays."""
    (texts, metas, y, digests), (pool_text, pool_meta) = labelled, pool
    held = digests % 5 == 0
    good = y.mean()
    prior = np.log(good / (1 - good))
    fit = [(x[~held], y[~held]) for x in (texts, metas)]
    known = [set(), set()]
    for turn in range(rounds + 1):
        views = [quality.View.fit(*f) for f in fit]
        if turn == rounds:
            break
        scores = [views[0].raw(pool_text), views[1].raw(pool_meta)]
        for own, other in ((0, 1), (1, 0)):
            s, n, sure = np.sort(scores[own]), len(pool_text), np.log(confident / (1 - confident))
            low, high = (s[max(0, math.ceil(q * n) - 1)] for q in (share * (1 - good), 1 - share * good))
            new = [(i, v) for v, hit in ((1.0, scores[own] >= max(sure, high)), (0.0, scores[own] <= min(-sure, low))) for i in np.flatnonzero(hit) if i not in known[other]]
            new.sort()
            known[other] |= {i for i, _ in new}
            x, t = fit[other]
            fit[other] = np.concatenate([x, (pool_text, pool_meta)[other][[i for i, _ in new]]]), np.concatenate([t, [v for _, v in new]])
    return prior, [v.calibrated(x[held], y[held]) for v, x in zip(views, (texts, metas))], known


def test_co_training_by_brute_force(spark, monkeypatch):
    """Every round scores the whole pool; both views teach each other."""
    rng = np.random.default_rng(0)
    monkeypatch.setattr(quality, "TEXT_FEATURES", 2)
    monkeypatch.setattr(quality, "META_FEATURES", 2)
    y = rng.integers(0, 2, 1500).astype(float)
    text, meta = (np.column_stack([y + rng.normal(0, s, 1500), rng.normal(size=1500)]).astype(quality._STORED) for s in (0.3, 0.4))
    as_bytes = lambda m: [r.tobytes() for r in m]
    n = 60
    labelled = pd.DataFrame({"digest": np.arange(n), "quality": y[:n], "text": as_bytes(text[:n]), "meta": as_bytes(meta[:n])})
    pool = spark.createDataFrame([(i, i - n, bytearray(t), bytearray(m)) for i, (t, m) in enumerate(zip(as_bytes(text), as_bytes(meta)))], "id bigint, digest bigint, text binary, meta binary")
    marked = spark.range(n)
    model = quality.co_train(labelled, pool, marked, rounds=3, share=0.1, confident=0.9)
    text, meta = text.astype(float), meta.astype(float)
    prior, (a, b), known = brute_co_training((text[:n], meta[:n], y[:n], np.arange(n)), (text[n:], meta[n:]), 3, 0.1, 0.9)
    assert min(map(len, known)) > 100 and model.prior == pytest.approx(prior)
    assert np.allclose(model.text.logit(text), a.logit(text), atol=1e-6) and np.allclose(model.meta.logit(meta), b.logit(meta), atol=1e-6)
    both = model.text.logit(text) + model.meta.logit(meta) - model.prior
    assert ((both > 0) == (y == 1)).mean() > 0.97
    few = quality.co_train(labelled, pool, marked, rounds=3, share=0.1, confident=0.9, teach=20)
    assert ((few.text.logit(text) + few.meta.logit(meta) - few.prior > 0) == (y == 1)).mean() > 0.95


# 5 ---------------------------------------------------------------------------------------------


def brute_lines(docs_, m, chars):
    """By definition: every run that occurred earlier goes, the longest from each line on; shared lines join them."""
    order, out = sorted(set(docs_), key=lambda d: (d[0] is None, d[0] or 0)), {}
    texts = [t.split("\n") if t is not None else [] for _, t in order]
    filled = [[i for i, x in enumerate(ls) if x.strip(" ")] for ls in texts]
    seqs = [[ls[i] for i in f] for ls, f in zip(texts, filled)]

    def earlier(d, s, e):
        run = seqs[d][s:e]
        return any(seqs[o][p : p + len(run)] == run for o in range(d + 1) for p in range(len(seqs[o]) if o < d else s))

    for d, (doc, text) in enumerate(order):
        n, runs = len(seqs[d]), []
        for s in range(n):
            ends = [e for e in range(s + 1, n + 1) if (e - s >= m or len(seqs[d][s]) >= chars and e == s + 1) and earlier(d, s, e)]
            for e in ends[:1] + ends[-1:]:
                if runs and s < runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], e)
                else:
                    runs.append([s, e])
        gone = {i for s, e in runs for i in range(filled[d][s], filled[d][e - 1] + 1)}
        out[doc, text] = (None, 0, 0) if text is None else ("\n".join(x for i, x in enumerate(texts[d]) if i not in gone), len(texts[d]), len(gone))
    return out


@pytest.mark.parametrize("m", [1, 2, 3, 5])
def test_line_dedup_by_brute_force(spark, m):
    rng = np.random.default_rng(m)
    made = [(i, "\n".join(rng.choice(["p", "q", "r", "", " ", "a line of many letters"], rng.integers(0, 14)))) for i in range(40)]
    made += [(50, "a\nb\nc\nd\ne\nf"), (51, "x\na\nb\nc\nd\ne\nf\ny"), (52, "a\nb\nc\nd\ne\nf"), (53, None), (None, "a\nb\nc\nz"), (54, ""), (50, "a\nb\nc\nd\ne\nf"), (55, "k\n" * 60)]
    frame = spark.createDataFrame(made, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in EXTRA})
    want = brute_lines(made, m, 20)
    got = lines.dedup_lines(frame, min_lines=m, keep=["doc_id", "rank"], min_chars=20).collect()
    assert len(got) == len(made)
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_deleted"]) for r in got) == Counter((d, *want[d, t]) for d, t in made)


def test_every_run_that_occurred_earlier_goes(spark):
    made = [("d1", "A\nB\nx\ny"), ("d2", "B\nC\nz\nw"), ("d3", "k\nA\nB\nC\nq"), ("d4", "A\n\nB\nv"), ("d5", "u\n" + "w" * 100 + "\nt"), ("d6", "w" * 100), ("d7", "A")]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(made, "doc_id string, text string")).collect()}
    assert got == dict(made) | {"d3": "k\nq", "d4": "v", "d6": ""}


def test_a_third_of_all_rows_one_text(spark):
    text = "\n".join(f"line {i}" for i in range(30))
    made = [(i, text if i % 3 == 0 else f"own {i}\nown {i + 1000}") for i in range(300)]
    got = {r["doc_id"]: r["n_deleted"] for r in lines.dedup_lines(spark.createDataFrame(made, "doc_id bigint, text string")).collect()}
    assert got == {i: 30 if i % 3 == 0 and i else 0 for i in range(300)}


def test_line_dedup_of_nothing(empty):
    assert lines.dedup_lines(empty).count() == 0


# 6 ---------------------------------------------------------------------------------------------


def test_mix_meets_targets(spark, sf_dir):
    found = queries.op6_mixing(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"), "doc_id").toPandas()
    by = found.groupby("source").agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by["source_size"]).all() and abs(by["target"].sum() - by["size"].sum()) < 1e-3
    assert (abs(by["taken"] - by["target"]) <= 0.01 * by["target"]).all()
    assert (found["taken"] <= 3 * found["size"]).all()
    again = queries.op6_mixing(spark, sf_dir).toPandas()
    a, b = (x.sort_values(["doc_id"]).reset_index(drop=True)[["doc_id", "taken"]] for x in (found, again))
    assert a.equals(b)


def test_targets_share_the_excess():
    sizes = np.array([10.0, 1.0, 89.0, 0.0])
    got = mixing.targets(sizes, np.array([1.0, 2.0, 3.0, 1.0]))
    assert abs(got.sum() - 100) < 1e-9 and (got <= 3 * sizes + 1e-9).all() and got[1] == 3 and got[3] == 0
    assert mixing.targets(np.zeros(0), np.zeros(0)).size == 0


def brute_mix(docs_, seed):
    """taken by (source, id, size): the stream word by word, blocks, slots and permutations one at a time."""
    sized = [(s, i, len((t or "").split())) for i, t, s in docs_]
    order = sorted({s for s, _, _ in sized}, key=lambda s: (s is None, s or ""))
    sizes = np.array([sum(n for s, _, n in sized if s == o) for o in order])
    target = mixing.targets(sizes, np.arange(len(order)) % 3 + 1.0)
    blocks = mixing.block_counts(sizes, target)
    slots = np.minimum(3 * blocks, np.rint(target * blocks / np.maximum(sizes, 1))).astype(int)
    taken = {}
    for rank, (m, n) in enumerate(zip(blocks.tolist(), sizes.tolist())):
        times = Counter()
        for slot in range(slots[rank]):
            key = ((rank + 1) * 7_919 + slot // m) * 1_000_003 + seed
            times[int(mixing.permute(np.array([slot % m]), np.array([m]), np.array([key]))[0])] += 1
        assert all(v <= 3 for v in times.values())
        taken[order[rank]] = (target[rank], [times[j] for j in range(m) for _ in range(j * n // m, (j + 1) * n // m)])
    return taken


def test_small_sources_meet_their_targets_by_brute_force(spark):
    made = [(i, prose(500 + i, n), s) for i, (n, s) in enumerate([(70, "a"), (70, "b"), (30, "c"), (40, "c"), (0, "c"), (1, "d"), (400, None), (7, None), (3000, "e")])]
    found = mixing.mix_report(spark.createDataFrame(made, "doc_id bigint, text string, source string"), seed=3).collect()
    source = {i: s for i, _, s in made}
    for s, (target, times) in brute_mix(made, 3).items():
        own = [r for r in found if source[r["doc_id"]] == s]
        assert sum(r["taken"] for r in own) == sum(times) and abs(sum(times) - target) <= max(0.01 * target, 0.5)
        assert {r["target"] for r in own} == {target} and all(r["taken"] <= 3 * r["size"] for r in own)
    # Which words of the stream a document has follows from the hash of its bucket: some order of the rows gives all counts.
    own, times = [r for r in found if source[r["doc_id"]] == "c" and r["size"]], brute_mix(made, 3)["c"][1]
    counts = lambda rs: [sum(times[sum(x["size"] for x in rs[:k]) :][: r["size"]]) for k, r in enumerate(rs)]
    assert any(counts(rs) == [r["taken"] for r in rs] for rs in (own, own[::-1]))


def test_permutations_and_shard_counts():
    for n in (1, 2, 3, 8, 97, 1000):
        image = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 12345))
        assert sorted(image) == list(range(n))
    slots = np.array([5, 0, 1000, 33])
    counts = mixing.shard_counts(slots, 8, 3)
    assert (counts.sum(axis=0) == slots).all() and np.ptp(counts.sum(axis=1)) <= 1


def test_mix_edges(docs, empty):
    found = mixing.mix_report(docs).collect()
    assert len(found) == len(ROWS) and {r["taken"] for r in found if r["size"] == 0} == {0}
    assert all(r["size"] == len((t[1] or "").split()) for r, t in zip(sorted(found, key=lambda r: repr(r["doc_id"])), sorted(ROWS, key=lambda t: repr(t[0]))))
    assert mixing.mix_report(empty).count() == 0 and mixing.mix(empty).count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r["doc_id"]] += len(r["text"].split())
    want = Counter()
    for r in found:
        want[r["doc_id"]] += r["taken"]
    assert +words == +want


# 7 ---------------------------------------------------------------------------------------------


def test_shards_are_gapless_and_even(docs, empty, spark, sf_dir):
    for frame, n in ((spark.read.parquet(f"{sf_dir}/documents.parquet"), 40), (docs, 5)):
        found = sharding.assign_shards(frame, n).collect()
        slots = {}
        for r in found:
            slots.setdefault(r["shard"], []).append(r["slot"])
            text = r["text"]
            assert r["size"] == 16 + len((text or "").encode()) and r["text_crc32"] == (None if text is None else zlib.crc32(text.encode()))
            assert r["law"] == "rows" and r["grown_shard"] is None
        sizes = [len(slots.get(s, [])) for s in range(n)]
        assert sum(sizes) == frame.count() and max(sizes) - min(sizes) <= 1
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign_shards(empty, 40).count() == 0


def test_shards_do_not_depend_on_the_partitions(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = lambda f: {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.assign_shards(f, 40, keep=["doc_id"]).collect()}
    assert place(frame) == place(frame.repartition(13).sortWithinPartitions("text"))


def test_shards_of_text_ids(spark):
    found = sharding.assign_shards(spark.createDataFrame([(f"id{i}", "x" * i) for i in range(50)] + [(None, None)], "doc_id string, text string"), 4).collect()
    assert sorted(r["slot"] * 4 + r["shard"] for r in found) == list(range(51))


@pytest.mark.parametrize(("n", "walk"), [(1, 64), (2, 64), (3, 64), (10, 64), (97, 64), (1000, 64), (4097, 64), (4097, 1), (1000, 1)])
def test_feistel_is_a_permutation(spark, n, walk, monkeypatch):
    monkeypatch.setattr(sharding, "WALK", walk)
    assert sorted(r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 5)).collect()) == list(range(n))


# 8 ---------------------------------------------------------------------------------------------


def test_repeated_passages_are_cut_and_clean_texts_are_not(docs, empty):
    found = substrings.dedup_substrings(docs).collect()
    by = {r["doc_id"]: r for r in found}
    assert len(found) == len(ROWS)
    assert by[1]["text"] == ROWS[0][1] and by[2]["n_removed"] > 0.8 * len(ROWS[1][1])
    assert by[3]["text"] == ROWS[2][1] and by[4]["n_removed"] > len(PASSAGE) / 2
    assert prose(5) in by[4]["text"] and prose(6)[60:] in by[4]["text"]
    assert by[8]["text"] == LONG and by[5]["text"] is None and by[6]["text"] == ""
    assert [r["text"] for r in found if r["doc_id"] == 9] == [prose(9)] * 2
    assert substrings.dedup_substrings(empty).count() == 0


def test_cut_points_depend_on_the_last_bytes_only_and_keep_characters():
    data = np.frombuffer(("xy " + LONG + "ü" * 500).encode(), dtype=np.uint8)
    cuts = substrings.cut_points(data)
    assert {c + 5 for c in cuts if c > 40} == {c for c in substrings.cut_points(np.concatenate([data[:3], data[:2], data])) if c > 45}
    for a, b in zip([0, *cuts], [*cuts, len(data)]):
        bytes(data[a:b]).decode()


def naive_chunks(text):
    """Chunks by definition: the gear hash byte by byte, and from each cut to the first one far enough."""
    gear, h, cuts = [int(x) for x in substrings._GEAR], 0, [0]
    for i, byte in enumerate(text[:-1]):
        h = (2 * h + gear[byte]) % (1 << 32)
        # The hash looks back on 32 bytes, before the text on zeros.
        if (h + sum(gear[0] << k for k in range(i + 1, 32))) % (1 << 32) < (1 << 32) // substrings.CUT_EVERY and text[i + 1] & 0xC0 != 0x80:
            cuts.append(i + 1)
    found = {(0, len(text))} if text else set()
    for a in cuts:
        ends = [b for b in [*cuts[1:], len(text)] if b - a >= substrings.MIN_CHUNK]
        found |= {(a, ends[0])} if ends else set()
    return found


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_repeated_chunks_by_brute_force(spark, kind):
    rng = np.random.default_rng(8)
    pieces = [prose(8000 + i, 25) for i in range(12)] + ["é" * 90, "short"]
    made = [(int(i), "\n".join(rng.choice(pieces, rng.integers(0, 6)))) for i in rng.permutation(60) + 100]
    made += [(None, pieces[3] * 2), (107, None), made[5], made[5]]
    frame = spark.createDataFrame(made, "doc_id bigint, text string").withColumn("doc_id", F.col("doc_id").cast(kind)).repartition(7)
    first, want = {}, set()
    for i, text in sorted(set(made), key=lambda r: (r[0] is None, r[0] or 0, r[1] is None)):
        data = (text or "").encode()
        want |= {(i, a, b) for a, b in sorted(naive_chunks(data)) if first.setdefault(data[a:b], (i, a)) != (i, a)}
    found = substrings.repeated_spans(frame).collect()
    got = {(r["id"] if r["id"] is None else int(r["id"]), s["start"], s["end"]) for r in found for s in r["spans"]}
    assert got == want and len(want) > 250


def test_a_short_shared_line_stays_and_a_short_copy_goes(spark):
    line = "one short line that very many documents share between their texts"
    made = [(i, f"{prose(300 + i, 30)}\n{line}\n{prose(400 + i, 30)}") for i in range(20)] + [(50, "tiny text"), (51, "tiny text")]
    found = {r["doc_id"]: r["text"] for r in substrings.dedup_substrings(spark.createDataFrame(made, "doc_id bigint, text string")).collect()}
    assert all(found[i] == t for i, t in made[:21]) and found[51] == ""


def test_hot_and_batched_chunks(spark):
    made = [(i, PASSAGE) for i in range(500)] + [(1000 + i, prose(2000 + i)) for i in range(50)]
    frame = spark.createDataFrame(made, "doc_id bigint, text string").repartition(7)
    found = {r["doc_id"]: r["n_removed"] for r in substrings.dedup_substrings(frame).collect()}
    assert found[0] == 0 and all(found[i] >= len(PASSAGE) - 200 for i in range(1, 500)) and not any(found[1000 + i] for i in range(50))


def test_exact_copies_of_any_length_go_whole(spark):
    texts = [LONG.replace(" ", "")[1000 * i : 1000 * i + n] for i, n in enumerate([65, 70, 80, 90, 99, 100, 110, 130, 150, 180, 250, 400, 700, 990])]
    texts += ["é" * 40 + prose(77, 4), prose(78, 9) + "\U0001f600"]
    made = [(100 * k + i, t) for k in range(4) for i, t in enumerate(texts)] + [(None, t) for t in texts]
    found = substrings.dedup_substrings(spark.createDataFrame(made, "doc_id bigint, text string").repartition(5)).collect()
    assert all(r["text"] == texts[r["doc_id"]] if r["doc_id"] is not None and r["doc_id"] < 100 else r["text"] == "" and r["n_spans"] == 1 for r in found)


def test_passages_go_up_to_their_last_byte(spark):
    made = []
    for i in range(30):
        passage = prose(5000 + i, 80) + "é"
        for k in range(3):  # what stands around differs in its first byte, twice within a character
            before, after = ("ü", "ñ", "x")[k], ("è", "ê", "y")[k]
            made.append((1000 * k + i, f"{prose(6000 + 100 * k + i, 30)}{before}{passage}{after}{prose(7000 + 100 * k + i, 30)}"))
    made += [(5000, f"{made[0][1][:300]}#and#{made[1][1]}")]
    found = {r["doc_id"]: r for r in substrings.dedup_substrings(spark.createDataFrame(made, "doc_id bigint, text string").repartition(6)).collect()}
    for i, text in made[:-1]:
        passage = prose(5000 + i % 1000, 80) + "é"
        assert found[i]["text"] == (text if i < 1000 else text.replace(passage, "")) and found[i]["n_removed"] == (0 if i < 1000 else len(passage.encode()))
    assert found[5000]["text"] == "#and#"


# 9 ---------------------------------------------------------------------------------------------


def brute_fingerprint(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, linked):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if linked(fps[i], fps[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash_by_brute_force(docs, empty):
    got = simhash.near_duplicates(docs, shingle=3, distance=2).collect()
    assert len(got) == len(ROWS)
    fps = [brute_fingerprint(r[1], 3) for r in ROWS]
    roots = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {root: min(r[0] for r, x in zip(ROWS, roots) if x == root and r[0] is not None) if any(x == root and r[0] is not None for r, x in zip(ROWS, roots)) else None for root in set(roots)}
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == Counter((r[0], f, least[x]) for r, f, x in zip(ROWS, fps, roots))
    assert simhash.near_duplicates(empty, shingle=3).count() == 0


@pytest.mark.parametrize(("distance", "pair_bucket"), [(0, 32), (1, 0), (1, 32), (2, 0), (2, 3), (2, 1000)])
def test_links_connect_what_brute_force_connects(spark, distance, pair_bucket):
    rng = np.random.default_rng(distance)
    centres = rng.integers(-(1 << 63), 1 << 63, 6)
    fps = {int(c) ^ simhash._signed(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))) for c in centres for _ in range(25)}
    fps = sorted(fps | {int(x) for x in rng.integers(-(1 << 63), 1 << 63, 30)})
    edges = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp bigint"), distance, 5, pair_bucket)
    labels = {r["node"]: r["label"] for r in components.connected_components(edges).collect()}
    roots = brute_components(fps, lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= distance)
    assert [labels.get(f, f) for f in fps] == [min(f for f, y in zip(fps, roots) if y == x) for x in roots]


@pytest.mark.parametrize("tile", [2048, 6])
def test_similar_links_by_brute_force(spark, tile, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "_COUNTED", 2)
    rng = np.random.default_rng(4)
    flip = lambda n: sum(1 << int(b) for b in rng.choice(64, n, replace=False))
    nodes = []
    for _ in range(5):
        fp, word = (int(x) for x in rng.integers(0, 1 << 63, 2))
        nodes += [(simhash._signed(fp ^ flip(rng.integers(0, 9))), simhash._signed(word ^ flip(rng.integers(0, 4)))) for _ in range(25)]
        nodes += [(simhash._signed(fp), simhash._signed(word ^ flip(k))) for k in (0, 1, 2)]  # one fingerprint, other words
    edges = simhash.similar_links(spark.createDataFrame([(i, *n) for i, n in enumerate(nodes)], "node bigint, fp bigint, word_fp bigint"), 12)
    labels = {r["node"]: r["label"] for r in components.connected_components(edges).collect()}
    masks = simhash._block_masks(6, 9)
    roots = brute_components(nodes, lambda a, b: ((a[0] ^ b[0]) % (1 << 64)).bit_count() <= 12 and any((a[1] ^ b[1]) & m == 0 for m in masks) or a[0] == b[0])
    assert [labels.get(i, i) for i in range(len(nodes))] == [min(i for i, y in enumerate(roots) if y == x) for x in roots]


def test_buckets_may_end_anywhere_in_a_batch(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 6)
    rng = np.random.default_rng(6)
    groups, rows_ = [], []
    for n in [*range(2, 40), *[1] * 60]:  # one bucket each, of one centre's neighbours
        fp, word = (int(x) for x in rng.integers(0, 1 << 63, 2))
        near = {fp ^ sum(1 << int(b) for b in rng.choice(64, 6, replace=False)) for _ in range(n)}
        groups.append(range(len(rows_), len(rows_) + len(near)))
        rows_ += [(len(rows_) + i, simhash._signed(x), word) for i, x in enumerate(near)]
    frame = spark.createDataFrame(rows_, "node bigint, fp bigint, word_fp bigint")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    try:
        edges = simhash.similar_links(frame, 12, agreeing=1, blocks=1)
        labels = {r["node"]: r["label"] for r in components.connected_components(edges).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for g in groups:
        assert {labels.get(i, i) for i in g} == {min(g)}


@pytest.mark.parametrize("own,kept", [(60, 6), (2, 1)])
def test_texts_of_one_fingerprint_are_compared(spark, own, kept):
    """A line that stands 80 times outvotes all else in a fingerprint; the sets of shingles tell them apart."""
    line = "permission is granted free of charge to any person"
    made = [(i, "\n".join([line] * 80) + "\n" + prose(5000 + i, own)) for i in range(6)]
    frame = spark.createDataFrame(made + [(10 + i, t) for i, t in made], "doc_id bigint, text string")
    fps = {r["fp"] for r in simhash.fingerprints(frame).collect()}
    assert len(fps) == 1
    assert sorted(r["doc_id"] for r in simhash.keep_one(frame).collect()) == list(range(kept))


def test_a_text_of_twenty_million_characters(spark):
    frame = spark.range(3).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("some words over and over "), 800_000), (F.col("id") % 2).cast("string")).alias("text"))
    found = {r["doc_id"]: r["fp"] for r in simhash.fingerprints(frame).collect()}
    assert len(found) == 3 and found[0] == found[2]


def test_near_duplicates_of_the_pipeline_by_brute_force(spark):
    """No document goes without a link of cosine 0.8, and nine of ten linked documents go, in each band."""
    rng = np.random.default_rng(31)
    made = []
    for family in range(60):
        base = prose(900 + family, int(rng.integers(80, 500))).split()
        for copy in range(4):
            w = list(base)
            for at in rng.choice(len(w), int(len(w) * [0, 0.01, 0.02, 0.04][copy]), replace=False):
                w[at] = "edited" + str(rng.integers(1000))
            made.append((int(rng.permutation(4)[0]) * 1000 + len(made), " ".join(w)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in made]
    cosine = lambda x, y: len(x & y) / math.sqrt(len(x) * len(y))
    roots = brute_components(sets, lambda x, y: cosine(x, y) >= 0.8)
    want = {min(made[i][0] for i, y in enumerate(roots) if y == x) for x in set(roots)}
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(made, "doc_id bigint, text string")).collect()}
    assert want <= kept and len(kept - want) <= 0.1 * (len(made) - len(want))
    jaccard = [(i, j) for i in range(len(made)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(jaccard) > 60 and np.mean([made[i][0] in kept and made[j][0] in kept for i, j in jaccard]) < 0.1


def test_a_spanning_forest_has_the_nearest_of_each():
    rng = np.random.default_rng(7)
    one = lambda n: np.uint64(1) << rng.integers(0, n, 60).astype(np.uint64)
    fps = rng.integers(0, 1 << 63, 4, dtype=np.uint64)[rng.integers(0, 4, 60)] ^ one(12) ^ one(30)
    word_fps = one(64) ^ one(64)
    a, b = simhash._forest(fps, word_fps, 4)
    found = {frozenset(x) for x in zip(a.tolist(), b.tolist())}
    gap = lambda i, j: int(fps[i] ^ fps[j]).bit_count()
    both = lambda i, j: gap(i, j) + int(word_fps[i] ^ word_fps[j]).bit_count()
    for i in range(60):
        near = {j: both(i, j) for j in range(60) if j != i and gap(i, j) <= 4}
        assert not near or any(frozenset((i, j)) in found for j, g in near.items() if g == min(near.values()))
    joined = brute_components(range(60), lambda i, j: frozenset((i, j)) in found)
    wanted = brute_components(range(60), lambda i, j: gap(i, j) <= 4)
    assert len(found) == 60 - len(set(wanted)) and len(set(joined)) == len(set(wanted))


def test_keep_one(spark, docs, empty):
    base = prose(70, 300).split()
    near = [(100 + i, " ".join([*base[:i], "changed", *base[i + 1 :]]), "en", "s", 1) for i in range(0, 40, 4)]
    frame = spark.createDataFrame(ROWS + near, DOCS).withColumns({c: F.lit("x") for c in EXTRA})
    kept = simhash.keep_one(frame)
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert kept.columns == frame.columns and sum(ids[n[0]] for n in near) == 1 and ids[100] == 1
    assert ids[1] == 1 and ids[2] == 0 and ids[9] == 1 and ids[3] == ids[4] == ids[8] == ids[None] == 1
    assert ids[5] + ids[6] + ids[7] == 1
    assert simhash.keep_one(empty).count() == 0


# 10 --------------------------------------------------------------------------------------------


def test_top_k_edges(spark):
    rng = np.random.default_rng(3)
    made = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    made += [(100 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(70)]
    made += [(200, None), (220, [1.0, None, 1.0, 1.0]), (240, [float("nan")] * 4), (260, [float("inf")] * 4), (280, [1.0, 2.0]), (None, [1.0] * 4), (20, made[20][1]), (300, []), (320, [1e12] * 4)]
    frame = spark.createDataFrame(made, "vec_id bigint, embedding array<double>").withColumns({c: F.lit("x") for c in EXTRA})
    got = [tuple(r) for r in covertree.top_k(frame, F.col("id") % 20 == 0, data_block=16, query_block=4).collect()]
    good = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in made if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for a, (i, v) in enumerate(good):
        if i is not None and i % 20 == 0:
            found = sorted((-sum(x * y for x, y in zip(v, w)), 1000 if j is None else j, b) for b, (j, w) in enumerate(good) if a != b and len(v) == len(w))[:20]
            want += [(i, r + 1, None if j == 1000 else j, -s) for r, (s, j, _) in enumerate(found)]
    assert Counter(got) == Counter(want)
    assert covertree.top_k(frame.limit(0), F.col("id") % 20 == 0).count() == 0


@pytest.mark.parametrize("clusters", [1, 60])
def test_top_k_in_several_rounds(spark, clusters):
    rng = np.random.default_rng(clusters)
    points = (rng.normal(0, 30, (clusters, 6))[rng.integers(0, clusters, 3000)] + rng.normal(0, 1, (3000, 6))).round(3)
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id bigint, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in covertree.top_k(frame, F.col("id") % 20 == 0, k=5, data_block=64, query_block=32).collect()}
    whole = np.floor(points * 64).astype(np.int64)
    scores = whole[::20] @ whole.T
    want = {}
    for q, own in enumerate(scores):
        own[20 * q] = -(1 << 62)
        for rank, i in enumerate(np.lexsort((np.arange(3000), -own))[:5]):
            want[20 * q, rank + 1] = (int(i), int(own[i]))
    assert got == want


def test_top_k_out_of_range(spark):
    for huge in (1e300, 1e13):
        frame = spark.createDataFrame([(20, [huge, huge]), (40, [huge, huge])], "vec_id bigint, embedding array<double>")
        with pytest.raises(Exception, match="beyond"):
            covertree.top_k(frame, F.col("id") % 20 == 0).collect()


def test_search_prunes_clustered_points():
    rng = np.random.default_rng(5)
    points = np.floor(64 * np.concatenate([c + rng.normal(0, 0.05, (200, 8)) for c in rng.normal(0, 2, (30, 8))]))
    tree, queries_ = covertree.build_tree(points), covertree.build_tree(points[::10].copy(), covertree.QUERY_LEAF)
    best = covertree._Best(10, np.full(600, -np.inf), np.full(600, -1))
    made = covertree.search(queries_, tree, best, tree.order, tree.order)
    assert made < 0.4 * 600 * 6000
    scores = queries_.points @ points.T
    for q in range(600):
        assert best.found[q][1].tolist() == np.lexsort((np.arange(6000), -scores[q]))[:10].tolist()


@pytest.mark.parametrize("even", [False, True])
def test_cover_tree_covers(even):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(720, 40)) if even else np.concatenate([c + rng.normal(0, 0.2, (60, 5)) for c in rng.normal(0, 20, (12, 5))])
    tree = covertree.build_tree(points, leaf=8)
    assert len(tree.radius) > 20 and sorted(tree.order) == list(range(len(points)))
    assert (tree.end - tree.start)[tree.children == 0].max() <= 8
    for i in range(len(tree.radius)):
        gap = tree.points[tree.start[i] : tree.end[i]] - tree.center[i]
        assert np.sqrt((gap**2).sum(axis=1)).max() <= tree.radius[i] + 1e-9


# SQL and pipeline -----------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, duck, sf_dir, name):
    found = queries.queries()[name](spark, sf_dir)
    want = duck.execute(queries.oracle_sql()[name])
    columns = sorted(c[0] for c in want.description)
    assert sorted(found.columns) == columns
    names = [c[0] for c in want.description]
    assert rows(found.select(*columns)) == sorted((tuple(r[names.index(c)] for c in columns) for r in want.fetchall()), key=repr)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    assert len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf_dir)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = (before, docs)
        if name != "sharding":
            assert docs.columns == columns
    before, after = seen["language_id"]
    assert after.count() > 0.95 * before.count()
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontaminate.contamination(seen["decontamination"][1], bench).filter("contaminated").count() == 0
    before, after = seen["simhash_near_dedup"]
    assert after.select("text").distinct().count() == after.count() < before.count()
    assert docs.count() == corpus_pipeline.run(spark, sf_dir).count()
