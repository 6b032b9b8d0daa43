"""Language ID and toxicity against brute force and held-out labels."""

import itertools
import math
import zlib

import numpy as np

from contrail.llm import language_id, toxicity
from contrail.llm.queries import op1_language_id, op9_toxicity

SF = "/root/testdata/sf0.01"
ODD = [(1, None, None), (2, "", "en"), (3, "   ", "en"), (4, "1234 --", None), (5, "w" * 50_000, "en"), (6, "the cat", "en"), (6, "the cat", "en"), (None, "le chat", "fr")]


def odd(spark, extra=True):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    return df.selectExpr("*", "'x' as score", "1 as predicted", "2 as k", "3 as t", "4 as h", "5 as n") if extra else df


def segmentations(word, p):
    """The sum over all segmentations, by trying every set of cuts."""
    total = 0.0
    for cuts in itertools.product((0, 1), repeat=len(word) - 1):
        parts, at = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(word[at:i])
                at = i
        parts.append(word[at:])
        total += math.prod(max(p.get(x, 0.0), language_id._FLOOR) if len(x) == 1 else p.get(x, 0.0) for x in parts)
    return total


def test_forward_sums_all_segmentations():
    vocab = sorted(["▁", "a", "b", "ab", "ba", "▁a", "bab", "▁ab"])
    p = np.array([[0.1 + 0.01 * i] for i in range(len(vocab))] + [[0.0]])
    by = {v: p[i, 0] for i, v in enumerate(vocab)}
    words = ["▁ab", "▁abab", "▁bab", "▁c", "▁"]
    got = language_id.log_likelihoods(words, language_id.Pieces(vocab), p)[:, 0]
    assert np.allclose(got, [math.log(segmentations(w, by)) for w in words])


def test_long_runs_are_summed_whole():
    """A rolling window over a run equals the plain forward pass in log space, however long the run is."""
    vocab = sorted(["a", "b", "ab", "ba", "abba", "▁", "▁a", "bab"])
    p = np.vstack([np.random.default_rng(1).uniform(1e-4, 0.3, (len(vocab), 2)), np.zeros((1, 2))])
    word = "▁" + "".join(np.random.default_rng(2).choice(list("abbac"), 50_000))
    logs = [np.zeros(2)]
    for e in range(1, len(word) + 1):
        terms = []
        for n in range(1, min(5, e) + 1):
            piece = word[e - n : e]
            q = p[vocab.index(piece)] if piece in vocab else np.zeros(2)
            q = np.maximum(q, language_id._FLOOR) if n == 1 else q
            terms.append(logs[e - n] + np.log(np.maximum(q, 1e-300)))
        logs.append(np.logaddexp.reduce(terms, axis=0))
    pieces = language_id.Pieces(vocab)
    assert np.allclose(language_id.log_likelihoods([word], pieces, p)[0], logs[-1], rtol=1e-9)
    for n in (20, 31, 32, 33, 40, 4096, 4097, 8200):
        assert np.allclose(language_id.log_likelihoods([word[:n]], pieces, p)[0], logs[n], rtol=1e-9)


def test_letters_alone_are_words(spark):
    assert language_id.letter_runs("A²b ½ ① x_y 3d é") == ["a", "b", "x", "y", "d", "é"]
    rows = [(1, "½ ²"), (2, "①"), (3, "Ⅷ ٣"), (4, "the ½ cat")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = language_id.fit(spark.createDataFrame([(1, "the cat", "en"), (2, "le chat", "fr")], "doc_id long, text string, lang string"), list("acehlt") + ["▁the"])
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.predict(df, model).collect()} == {1: "und", 2: "und", 3: "und", 4: "en"}


def test_expected_counts():
    vocab = ["a", "aa"]
    p = np.array([[0.5], [0.2], [0.0]])
    # "aa": a.a 0.25, aa 0.2; expected a = 2 * 0.25 / 0.45
    got = language_id._expected(["aa"], np.array([3.0]), language_id.Pieces(vocab), p)
    assert np.allclose(got, [3 * 0.5 / 0.45, 3 * 0.2 / 0.45])


def test_language_held_out_accuracy(spark):
    rows = op1_language_id(spark, SF).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95


def test_language_edge_cases(spark):
    docs = odd(spark)
    model = language_id.fit(docs, ["a", "c", "e", "h", "l", "t", "w", "▁", "▁l", "▁t", "the", "le"])
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.predict(docs, model).collect()]
    assert len(got) == len(ODD)
    assert {g[1:] for g in got if g[0] in (1, 2, 3, 4)} == {("und", 0.0)}
    assert all(0 <= g[2] <= 1 for g in got) and (None, "fr") in {g[:2] for g in got}
    none = language_id.fit(docs.where("lang is null"), ["a"])
    assert {r["lang_pred"] for r in language_id.predict(docs, none).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_toxicity_held_out(spark):
    rows = {r["doc_id"]: r for r in op9_toxicity(spark, "/root/testdata/sf0.1").collect()}
    labels = [r for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect() if rows[r["doc_id"]]["held_out"]]
    marked = [rows[r["doc_id"]]["predicted"] for r in labels if r["toxic"] == 1]
    clean = [rows[r["doc_id"]]["predicted"] for r in labels if r["toxic"] == 0]
    assert np.mean(marked) > 0.6 and np.mean(clean) < 0.02  # a part of the labels is noise


def test_toxicity_edge_cases(spark):
    docs = odd(spark)
    train = spark.createDataFrame([(i, "you idiot" if i % 2 else "the cat sat", i % 2) for i in range(40)] + [(99, None, 1), (98, "x", None)], "doc_id long, text string, toxic int")
    model = toxicity.fit(train)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    bad = toxicity.score(spark.createDataFrame([(1, "what an idiot")], "doc_id long, text string"), model).first()
    assert bad["predicted"] == 1
    one = toxicity.fit(train.where("toxic = 0"))
    assert {r["predicted"] for r in toxicity.score(docs, one).collect()} == {0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_ratios_and_scores_by_hand(spark):
    """Features, log-count ratios, one step of the regression and a score against their definitions."""
    f = toxicity.Features(1 << 18, 3, 5)
    grams = lambda t: {zlib.crc32(g.encode()) & ((1 << 18) - 1) for w in set(t.split()) for m in ["^" + w + "$"] for k in (3, 4, 5) for g in [m[i : i + k] for i in range(len(m) - k + 1)]}
    texts, y = ["you idiot you", "bad idiot", "the cat", "the cat sat", ""], np.array([1, 1, 0, 0, 0])
    assert [set(f.of_text(t).tolist()) for t in texts] == [grams(t) for t in texts]
    assert all(len(f.of_text(t)) == len(grams(t)) for t in texts)
    model = toxicity.fit_arrays([f.of_text(t) for t in texts], y, 1 << 18, steps=1)
    pos, neg = sum(y), len(y) - sum(y)
    for g in set().union(*map(grams, texts)):
        p, q = (sum(g in grams(t) for t, c in zip(texts, y, strict=True) if c == k) for k in (1, 0))
        ratio = math.log(((p + 1) / (pos + 2)) / ((q + 1) / (neg + 2)))
        gradient = ratio * sum((0.5 / pos * -0.5 if c else 0.5 / neg * 0.5) for t, c in zip(texts, y, strict=True) if g in grams(t))
        assert abs(model.weights[g] - (0.02 * -np.sign(gradient) * ratio if abs(gradient) > 1e-6 else 0)) < 1e-4
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        assert abs(got[i] - 1 / (1 + math.exp(-(sum(float(model.weights[g]) for g in grams(t)) + model.bias)))) < 1e-6


def test_labelled_rows(spark):
    """Rows held out, without label or with conflicting labels, and repeated ids."""
    ids = [i for i in range(40)]
    docs = spark.createDataFrame([(i, f"t{i}", "x") for i in ids] + [(1, "again", "x"), (None, "n", "x")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids] + [(2, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    got = sorted((r["doc_id"], r["text"], r["toxic"]) for r in toxicity.labelled_rows(docs, labels).collect())
    free = [i for i in ids if zlib.crc32(str(i).encode()) % 5]
    want = [(i, f"t{i}", 1 if i == 2 else i % 2) for i in free] + ([(1, "again", 1)] if 1 in free else [])
    assert got == sorted(want)
    small = toxicity.fit(spark.createDataFrame([(i, "word%d other%d" % (i, i), i % 2) for i in range(200)], "doc_id long, text string, toxic int"), max_bytes=4000)
    assert 0 < np.count_nonzero(small.weights) < 2500
