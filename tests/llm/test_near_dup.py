"""ProbMinHash, verification and classes against brute force."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from contrail.llm import near_dup
from contrail.llm.queries import op4_near_dup


def weights(text, size=5):
    w = text.lower().split()
    n = min(size, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else Counter()


def jp(a, b):
    """J_P straight from its definition."""
    if not a or not b:
        return 0.0
    sa, sb = sum(a.values()), sum(b.values())
    every = set(a) | set(b)
    return sum(1 / sum(max(a[e] / sa / (a[d] / sa), b[e] / sb / (b[d] / sb)) for e in every) for d in set(a) & set(b))


def classes(rows, threshold=0.8):
    """Smallest id of everything connected, by all pairs."""
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    w = {i: weights(t) if t is not None else Counter() for i, t in rows}
    for k, (i, t) in enumerate(rows):
        for j, u in rows[:k]:
            if t is not None and u is not None and (t == u or (sum((w[i] & w[j]).values()) and jp(w[i], w[j]) >= threshold)):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in rows}


def test_exact_similarity_and_estimate():
    random.seed(3)
    for _ in range(20):
        a = [random.choice("abcdefgh") for _ in range(60)]
        b = a[:40] + [random.choice("abcdefgh") for _ in range(20)]
        x, y = " ".join(a), " ".join(b)
        s = near_dup.Shingles(2)
        got = near_dup.probability_jaccard(s.of(x), s.of(y))
        assert abs(got - jp(weights(x, 2), weights(y, 2))) < 1e-9
        m = 4000
        est = (near_dup.prob_minhash(*s.of(x), m) == near_dup.prob_minhash(*s.of(y), m)).mean()
        assert abs(est - got) < 0.05


def near_rows(n_group=40, n_other=60):
    random.seed(5)
    word = lambda: "".join(random.choice("abcdefghijklm") for _ in range(5))
    base = [word() for _ in range(150)]
    rows = []
    for i in range(n_group):
        t = list(base)
        for _ in range(random.choice([0, 1, 2, 3])):
            t[random.randrange(len(t))] = word()
        rows.append((i, " ".join(t)))
    chain = [word() for _ in range(120)]  # each is near the next, the ends are not
    for i in range(10):
        rows.append((100 + i, " ".join(chain)))
        chain = chain[4:] + [word() for _ in range(4)]
    rows += [(200 + i, " ".join(word() for _ in range(random.choice([1, 3, 5, 40])))) for i in range(n_other)]
    rows += [(300, None), (301, None), (302, ""), (303, ""), (304, "one two"), (305, "one two"), (306, "ONE two"), (307, "x" * 20000)]
    random.shuffle(rows)
    return rows


def test_against_all_pairs(spark):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as a", "3 as b", "4 as key", "5 as root")
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(df).collect()}
    assert got == classes(rows)


def test_one_leader_and_the_rest_agree(spark):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(df, leaders=1).collect()} == classes(rows)


def test_shared_and_null_ids_lose_no_link(spark):
    random.seed(11)
    word = lambda: "".join(random.choice("abcdefghijklm") for _ in range(5))
    a, b, c = (" ".join(word() for _ in range(150)) for _ in range(3))
    rows = [(1, a), (1, b), (2, a + " w"), (3, b + " w"), (None, c), (None, c + " w"), (4, None), (4, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit(1)).withColumn("n", F.lit(2))
    got = near_dup.near_duplicates(df).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=repr) == sorted([(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (None, None, 1), (None, None, 1), (4, 4, 0), (4, 4, 0), (None, None, 0)], key=repr)
    keys = Counter(r["class_key"] for r in got)
    assert keys.pop(None) == 3 and sorted(keys.values()) == [2, 2, 2]


def test_links_of_hot_groups(spark):
    """Every key that can be hot is: one text with many copies, a hub with many near copies, null ids."""
    rows = near_rows() + [(1000 + i, "same text over and over again") for i in range(3000)] + [(None, None)] * 1500
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_dup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    want = classes(near_rows()) | {1000 + i: 1000 for i in range(3000)}
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == want
    assert {(r["class_id"], r["n_links"]) for r in got if r["doc_id"] is None} == {(None, 0)}


def test_odd_inputs(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "a b c")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["class_id"]) for r in near_dup.near_duplicates(df).collect())
    assert got == [(0, 1), (1, 1), (1, 1), (2, 1)]
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


def test_query_against_all_pairs(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["class_id"] for r in op4_near_dup(spark, "/root/testdata/sf0.001").collect()}
    assert got == classes(rows)


def test_connected(spark):
    """Chains, stars and a ladder over ids in no order, and two small chains in order."""
    random.seed(2)
    ids = random.sample(range(1000, 10**6), 400)
    links = list(zip(ids[:100], ids[1:100])) + [(ids[100], x) for x in ids[101:200]] + [(a, b) for i in range(200, 398, 2) for a, b in ((ids[i], ids[i + 1]), (ids[i], ids[i + 2]))]
    links += [(i, i + 1) for i in range(5)] + [(50, 60), (60, 55), (70, 70)]
    random.shuffle(links)
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["id"]: r["root"] for r in near_dup.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert near_dup.connected(spark.createDataFrame([], "a long, b long")).count() == 0
