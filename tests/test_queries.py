"""Every registered query against its SQL oracle, and golden values of the column functions."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from contrail.functions import control, geo, text
from contrail.operators import tracks
from contrail.plans.queries import tracks_of_events
from contrail.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "events documents embeddings conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.sql(ORACLES[name])
    own = list(rel.columns)
    assert sorted(own) == cols
    want = sorted((tuple(norm(r[own.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert got == want


def test_range_join_is_no_nested_loop(spark):
    plan = tracks.nearest_enemy(tracks_of_events(spark.read.parquet(f"{SF}/events.parquet")), 5.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_golden_turns(spark):
    rows = [(0.0, 45.0, "turn 30"), (0.0, 315.0, "turn -30"), (0.0, 82.9, "turn 60"), (0.0, 4.0, ""), (350.0, 10.0, "turn 30"), (0.0, 45.1, "turn 60")]
    df = spark.createDataFrame(rows, "a double, b double, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", geo.turn_command(F.col("a"), F.col("b")).alias("got")).collect())


def test_golden_budget(spark):
    df = spark.createDataFrame([([1.0, 0.0, -2.0, 10.0, 5.0, 1.0],), ([16.0],), ([1.0] * 20,), ([],)], "h array<double>")
    assert [r[0] for r in df.select(control.budget_fold(F.col("h"))).collect()] == [[1.0, 10.0], [], [1.0] * 12, []]


def test_clamp_keeps_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (2.0,), (-3.0,), (0.5,), (None,)], "x double")
    got = [r[0] for r in df.select(control.clamp(F.col("x"))).collect()]
    assert math.isnan(got[0]) and got[1:] == [1.0, -1.0, 0.5, None]


def test_clean_text(spark):
    cases = {
        "short\nthis line is long enough\r\n\r\n　padded line of text ": "this line is long enough\npadded line of text",
        "mail me at joe@example.com today please": "mail me at [EMAIL] today please",
        "1234567890\n12345678901": "12345678901",
        "http://" + "a" * 200_000 + " tail of a long line": "[URL] tail of a long line",
        "": "",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", text.clean_text(F.col("t")).alias("got")).collect())


def test_number_text_is_half_even(spark):
    df = spark.createDataFrame([(0.125, "0.12"), (2.675, "2.67"), (1234567.005, "1234567.00"), (-0.4, "-0.40")], "x double, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", text.fixed(F.col("x"), 2).alias("got")).collect())


def test_first_seen_keeps_nulls(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, "b", "y")], "seq long, obj_id string, side string")
    assert {(r["obj_id"], r["side"]) for r in tracks.first_seen(df).collect()} == {("a", None), ("b", "y")}


def test_numbering_over_blocks(spark):
    seqs = [0, 1, 5, 6, 7, 30, 31, 200, 2**40]
    df = spark.createDataFrame([(x,) for x in seqs], "seq long")
    assert sorted((r["seq"], r["idx"]) for r in tracks.numbered(df, block=3).collect()) == [(x, i + 1) for i, x in enumerate(seqs)]
    assert tracks.numbered(df.limit(0)).count() == 0


def test_range_join_spreads(spark):
    """Either side may visit three buckets; a probe row without a partner comes once if the build side does."""
    probe = spark.createDataFrame([(i, float(t)) for i, t in enumerate([0, 4.9, 5, 10, 100, -3])], "i int, t double")
    build = spark.createDataFrame([(j, float(u)) for j, u in enumerate([0, 5, 9.9, 10, -8])], "j int, u double")
    want = {(a["i"], b["j"]) for a in probe.collect() for b in build.collect() if abs(a["t"] - b["u"]) <= 5}
    for spread in ("probe", "build"):
        assert {(r["i"], r["j"]) for r in tracks.range_join(probe, build, "t", "u", 5.0, spread=spread).collect()} == want
    left = [(r["i"], r["j"]) for r in tracks.range_join(probe, build, "t", "u", 5.0, how="left", spread="build").collect()]
    assert sorted(left, key=repr) == sorted(want | {(4, None)}, key=repr)
