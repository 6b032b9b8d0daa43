"""Segmented scans and splittable gates: a key over many tasks gives what one task gives; odd rows."""

import math
import random
import re

from pyspark.sql import functions as F

from contrail.operators import gates, scans


def rows_of(n, one_key):
    random.seed(n)
    return [(7 if one_key else random.choice([1, 2, None]), i * 3 % n, random.choice([None, 1, 2, 5]), "x") for i in range(n)]


def plain(rows):
    """Running values of each key in order, by one loop."""
    state, out = {}, {}
    for k, o, v, _ in sorted(rows, key=lambda r: r[1]):
        last, total, most, n, before = state.get(k, (None, 0, None, 0, None))
        now = (v if v is not None else last, total + (v or 0), max(x for x in (most, v, -1) if x is not None), n + 1, v if v is not None else last)
        out[o] = (now[0], now[1], None if now[2] == -1 else now[2], now[3], last)
        state[k] = (now[0], now[1], None if now[2] == -1 else now[2], now[3], None)
    return out


def scanned(df, block, levels=1):
    v = F.col("v")
    return scans.scan(df, ["k"], ["o"], block, levels, last=scans.Running("last", v), total=scans.Running("sum", v), most=scans.Running("max", v), n=scans.Running("sum", F.lit(1)), before=scans.Running("last", v, inclusive=False))


def test_scan_against_a_loop(spark, monkeypatch):
    for one_key in (True, False):
        rows = rows_of(400, one_key)
        df = spark.createDataFrame(rows, "k int, o long, v int, __other string")
        for block, group, levels in ((7, 4096, 1), (3, 4, 2)) if one_key else ((3, 5, 1), (1000, 4096, 0)):
            monkeypatch.setattr(scans, "BLOCK", group)
            got = {r["o"]: (r["last"], r["total"], r["most"], r["n"], r["before"]) for r in scanned(df, scans.blocks_of("o", block), levels).collect()}
            assert got == plain(rows)
    assert scanned(df.limit(0), scans.blocks_of("o", 3)).count() == 0


def test_one_key_is_many_tasks(spark):
    """No window over rows is by key alone, and a block holds no more than its rows."""
    df = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("o"), (F.col("id") % 9).alias("v"))
    x = scans.scan(df, ["k"], ["o"], scans.blocks_of("o", 500), s=scans.Running("sum", F.col("v")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tasks = x.select(F.spark_partition_id().alias("p"), "s").groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.max("s").alias("s")).collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(tasks) == 4 and max(r["n"] for r in tasks) < 15_000 and max(r["s"] for r in tasks) == sum(i % 9 for i in range(20_000))
    assert scans.blocks_of("o", 500) is not None and df.groupBy(scans.blocks_of("o", 500)).count().agg(F.max("count")).first()[0] == 500


def test_blocks_by_time_and_null_order(spark):
    rows = [(1, None, 4), (1, -0.5, None), (1, -90.0, 6), (1, 12.0, None), (1, 200.0, 7), (None, 3.0, None)]
    df = spark.createDataFrame(rows, "k int, o double, v int")
    got = {(r["k"], r["o"]): r["out"] for r in scans.carried_forward(df, ["k"], ["o"], F.col("v"), "out", scans.blocks_of("o", 10.0)).collect()}
    assert got == {(1, None): 4, (1, -90.0): 6, (1, -0.5): 6, (1, 12.0): 6, (1, 200.0): 7, (None, 3.0): None}


def test_closed_frames(spark):
    rows = [(1, i, c) for i, c in enumerate("aab#a##ab#a")] + [(None, 0, "a"), (None, 1, "#"), (None, 2, "a")]
    df = spark.createDataFrame(rows, "k int, o long, c string")
    for size in (2, 100):
        got = {(r["k"], r["frame_no"], r["n"]) for r in scans.closed_frames(df, ["k"], ["o"], F.col("c") == "#", scans.blocks_of("o", size)).collect()}
        assert got == {(1, 0, 3), (1, 1, 1), (1, 3, 2), (None, 0, 1)}


def accepted(times, interval):
    n, last = 0, None
    for t in sorted(times):
        if last is None or t - last >= interval:
            n, last = n + 1, t
    return n, last


def test_gate_against_a_loop(spark, monkeypatch):
    random.seed(4)
    keys = {k: [random.choice([random.uniform(0, 500), float(random.randint(0, 300)), random.randint(0, 900) / 7, 0.1 * random.randint(0, 3000)]) for _ in range(random.randint(0, 300))] for k in range(12)}
    keys[50] = [0.1 * i for i in range(2000)]  # equal steps: phases never meet, and differences are rounded
    keys[51] = [1e15 + i / 8 for i in range(300)] + [-1e15]
    data = [(k, t) for k, ts in keys.items() for t in ts] + [(k, None) for k in keys] + [(None, math.nan), (None, 2.0), (99, None)]
    random.shuffle(data)
    df = spark.createDataFrame(data, "k int, t double")
    want = {k: accepted(ts, 1.7) for k, ts in keys.items()} | {None: (1, 2.0), 99: (0, None)}
    for span, group in ((64, 64), (1, 2), (3, 5)):  # blocks of one interval upwards, groups of few blocks
        monkeypatch.setattr(gates, "SPAN", span)
        monkeypatch.setattr(gates, "GROUP", group)
        got = {r["k"]: (r["n"], r["last_t"]) for r in gates.refresh_gate(df, "k", "t", 1.7).collect()}
        assert got == want, (span, group)


def test_gate_has_no_python_and_no_window_over_a_key(spark):
    df = spark.range(10).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("t"))
    plan = gates.refresh_gate(df, "k", "t", 2.0)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Window" in plan
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all(re.search(r"windowspecdefinition\(k#\d+, b#\d+", line) for line in windows)
