"""Stupid backoff over bigrams of words against brute force."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest

from contrail.llm import lm_score
from contrail.llm.queries import ORACLES, op3_lm_score

SF = "/root/testdata/sf0.001"


def brute(texts, corpus=None):
    """Words, words backed off and score of each text, under the counts of a corpus or of all other texts."""
    split = lambda t: ["", *t.lower().split()] if t else [""]
    counts = lambda of: (Counter(of), Counter(p[0] for p in of), Counter(p[1] for p in of))
    pairs = lambda t: list(zip(split(t), split(t)[1:]))
    held = counts([p for t in (texts if corpus is None else corpus) for p in pairs(t)])
    out = []
    for t in texts:
        own = pairs(t)
        k, c, u = (a - b for a, b in zip(held, counts(own), strict=True)) if corpus is None else held
        total = max(1, sum(u.values()))
        each = [math.log(k[p] / c[p[0]]) if k[p] else math.log(0.4 * max(1, u[p[1]]) / total) for p in own]
        out.append((len(own), sum(not k[p] for p in own), round(sum(each), 3) + 0.0))
    return out


def some_rows(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(2**60 + 1, None), (2**60 + 2, ""), (2**60 + 3, " \t "), (2**60 + 4, "z" * 3000), (2**60 + 5, "a b　c d")]
    return rows + [(None, "a b a"), (None, "a b a"), (None, None), (7, "b a b"), (7, "b a b"), (7, "a a")]


def clashing(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as k", "2 as n", "3 as id", "4 as b", "5 as f", "6 as r", "7 as own", "8 as t")


def as_rows(df):
    return sorted(((r["doc_id"] or -1, r["n_words"], r["n_backed_off"], round(r["log_score"], 3) + 0.0) for r in df.collect()), key=repr)


def wanted(rows, corpus=None):
    return sorted(((i or -1, *x) for (i, _), x in zip(rows, brute([t for _, t in rows], corpus), strict=True)), key=repr)


BOUNDS = pytest.mark.parametrize("common, dense", [(0, 0), (20, 3), (50_000, 1024), (500, 0)])


@BOUNDS
def test_left_out_against_brute_force(spark, common, dense):
    rows = some_rows(spark)
    df = clashing(spark, rows)
    got = lm_score.score_left_out(df, common=common, dense=dense)
    want = wanted(rows)
    assert as_rows(got) == want
    assert 0 < sum(x[2] for x in want) < sum(x[1] for x in want)
    assert got.where("n_words = 0 and mean_log_score is not null").isEmpty()
    assert lm_score.score_left_out(df.limit(0), common=common, dense=dense).count() == 0


@BOUNDS
def test_corpus_against_brute_force(spark, common, dense):
    rows = some_rows(spark)
    corpus, own = rows[:150], rows[100:]
    df = clashing(spark, own)
    got = lm_score.score_against(df, clashing(spark, corpus), common=common, dense=dense)
    assert as_rows(got) == wanted(own, [t for _, t in corpus])
    assert lm_score.score_against(df.limit(0), df, common=common, dense=dense).count() == 0


def test_empty_corpus(spark):
    df = clashing(spark, [(1, "a b"), (2, None)])
    assert as_rows(lm_score.score_against(df, df.limit(0))) == [(1, 2, 2, round(2 * math.log(0.4), 3)), (2, 0, 0, 0.0)]


def test_one_text_of_very_many_words_and_odd_words(spark):
    rows = [(1, " ".join(f"w{i % 70_001}" for i in range(300_000))), (2, "\x02 a \x02 b"), (3, "a b w1 w2"), (4, "A\x02")]
    df = clashing(spark, rows)
    assert as_rows(lm_score.score_left_out(df, common=1000, dense=10)) == wanted(rows)


def test_no_pair_of_frequent_words_is_shuffled(spark):
    """However often frequent words meet, their pairs add no row: one row a text is left of them."""
    df = clashing(spark, [(i, "the of " * (i % 7)) for i in range(60)])
    plan = lm_score.score_left_out(df, dense=3)
    assert as_rows(plan) == wanted([(r["doc_id"], r["text"]) for r in df.collect()])
    assert lm_score.pair_counts(df, spark.sparkContext.broadcast(lm_score.common_words(lm_score.word_counts(df), 100)), 3).count() == 0


def shuffled_bytes(spark):
    none, details = spark._jvm.java.util.ArrayList(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, details, none)
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


def test_bytes_shuffled_for_a_bigram(spark):
    """Bigrams with their counts, and all else that is shuffled for them, take a few bytes each."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in (rng.random(3000) ** 3 * 20_000).astype(int)) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    before = shuffled_bytes(spark)
    assert lm_score.score_left_out(df, dense=0).agg({"n_words": "sum"}).first()[0] == 450_000
    used = sum(v for k, v in shuffled_bytes(spark).items() if k not in before)
    rows = sum(len(set(zip(t.split(), t.split()[1:]))) + 1 for t in texts)
    assert 0 < used < 14 * rows


def test_lists_give_back_what_they_hold():
    kinds = [np.int64, np.int32, np.int32]
    columns = [np.array([-(2**63), 2**63 - 1, 0, -1]), np.array([-1, 2**31 - 1, -(2**31), 7], np.int32), np.arange(4, dtype=np.int32)]
    for n in (0, 1, 4):
        got = lm_score._unpack(lm_score._pack([x[:n] for x in columns]), kinds, n)
        assert all(np.array_equal(x[:n], y) and x.dtype == y.dtype for x, y in zip(columns, got, strict=True))


def test_keys_of_either_sign_in_lists():
    """Keys from one end of the numbers to the other come back through their differences, each in one list."""
    k = np.array([5, -(2**63), 2**40 - 1, -1, 0, -7, 5])
    data = np.arange(28, dtype=np.int32).reshape(4, 7)
    names = [x[k < 0] for x in (np.arange(7, dtype=np.int32), -np.arange(7, dtype=np.int32), k, k + 1)]
    out = lm_score._lists(k, data, names, 0, 3, True, True)
    got = []
    for size, n, packed, named in zip(out["size"], out["rare"], out["data"], out["names"], strict=True):
        d, *rest = lm_score._unpack(packed, lm_score._DATA, size)
        key = np.cumsum(d)
        assert (key < 0).sum() == n
        names_of = [x.tolist() for x in lm_score._unpack(named, lm_score._NAMES, n)]
        got += [(int(key[i]), *(int(x[i]) for x in rest), *((x[i] for x in names_of) if i < n else ())) for i in range(size)]
    want = [(int(k[i]), *map(int, data[:, i]), *((i, -i, int(k[i]), int(k[i]) + 1) if k[i] < 0 else ())) for i in range(7)]
    assert sorted(got) == sorted(want)


def test_query_scores_the_order_of_words(spark, tmp_path):
    rows = [(1, "the cat sat on the mat"), (2, "mat the on sat cat the"), (3, "the cat sat on the mat again"), (4, "the cat sat")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["log_score"] for r in op3_lm_score(spark, str(tmp_path)).collect()}
    assert got[1] > got[2]


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rel = con.sql(ORACLES["op3_lm_score"])
    got = op3_lm_score(spark, SF).select(rel.columns).collect()
    assert len(got) == 200
    assert sorted(map(tuple, got)) == sorted(rel.fetchall())
    assert sum(r["n_backed_off"] for r in got) > 0
