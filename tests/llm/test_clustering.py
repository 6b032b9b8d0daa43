"""Adaptive-bounds clustering against plain k-means."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from contrail.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, id string, x int, cluster int, distance long"


def plain(rows, k, rounds, dims):
    kept = [(i, tuple(int(np.floor(1024 * float(np.float32(c)))) for c in v)) for i, v in rows if v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [r[1] for r in kept[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        c = [tuple(sum(col) // len(groups[j]) for col in zip(*groups[j], strict=True)) if j in groups else m for j, m in enumerate(c)]
    return sorted(((i, *nearest(v)[::-1]) for i, v in kept), key=repr), c


def check(spark, rows, k=8, rounds=10, dims=64, **options):
    df = spark.createDataFrame([(i, v, "a", 1, 2, 3) for i, v in rows], SCHEMA)
    members, c, computed = clustering.kmeans(df, k=k, rounds=rounds, dims=dims, **options)
    want, centroids = plain(rows, k, rounds, dims)
    assert sorted(((r["id"], r["cluster"], r["distance"]) for r in members.collect()), key=repr) == want
    assert [tuple(x) for x in c.tolist()] == centroids
    return computed


def test_against_plain_and_bounds_save_distances(spark):
    random.seed(5)
    middles = [[random.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, [m + random.gauss(0, 0.3) for m in middles[i % 12]]) for i in range(1500)]
    computed = check(spark, rows, k=12, rounds=8, dims=8, width=4, block=16, held=100)
    assert computed[0] == 1500 * 12 and sum(computed[4:]) < 0.35 * 1500 * 12 * len(computed[4:])


def test_ties_repeats_and_odd_rows(spark):
    random.seed(6)
    grid = [(i, [float(random.randint(-1, 1)) / 1024 for _ in range(4)]) for i in range(200)]  # equal distances everywhere
    odd = [(None, [0.0, 1.0, 2.0, -3.0]), (None, [0.0, 1.0, 2.0, -4.0]), (7, [0.5] * 4), (7, [0.5] * 4), (900, None), (901, []), (902, [1.0] * 3), (903, [None, 1.0, 1.0, 1.0]), (904, [float("nan")] * 4), (905, [float("inf")] * 4), (906, [1.0] * 5)]
    for width in (1, 2, 7):
        check(spark, grid + odd, k=8, rounds=6, dims=4, width=width, block=8, held=32)


def test_few_and_no_vectors(spark):
    check(spark, [(1, [1.0, 2.0]), (2, [3.0, 4.0]), (3, None)], k=8, rounds=3, dims=2)
    check(spark, [(1, [1.0, 2.0])] * 3, k=1, rounds=2, dims=2)
    check(spark, [(1, None)], k=8, rounds=3, dims=2)
    check(spark, [], k=8, rounds=3, dims=2)


def test_one_vector_a_third_of_all(spark):
    random.seed(7)
    check(spark, [(i, [1.0, 1.0, 1.0]) for i in range(300)] + [(1000 + i, [random.random() for _ in range(3)]) for i in range(600)], k=5, rounds=5, dims=3)


def test_too_large_components(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<float>")
    try:
        clustering.scaled(df, "vec_id", "embedding", 2, 1024.0).agg(F.sum(F.col("x")[0])).collect()
        raise AssertionError("no error")
    except Exception as e:
        assert "too large" in str(e)
