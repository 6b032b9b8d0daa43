"""Work that must not grow faster than its input: values computed once, searches and counts without rows of all pairs."""

import math
import random

import pytest

from pyspark.sql import functions as F

from contrail.functions import decisions
from contrail.operators import tracks


def test_action_vector_computes_its_action_once(spark):
    """Six times one random number: slots that compute the action anew would differ."""
    got = spark.range(50).select(decisions.action_vector(F.array_repeat(F.rand(3), 6).cast("array<float>")).alias("a")).collect()
    for r in got:
        assert len(r["a"]) == 640 and {r["a"][i] for i in (0, 1, 2, 8, 9, 10)} == {r["a"][0]} != {0.0}
        assert not any(v for i, v in enumerate(r["a"]) if i not in (0, 1, 2, 8, 9, 10))


def test_keys_of_variants(spark):
    """A key is there whatever its value, and only in an object."""
    said = {'{"a": null}': True, '{"a": {"b": 1}}': True, '{"b": {"a": 1}}': False, "[1]": False, '"a"': False, "7": False, "null": False}
    df = spark.createDataFrame([(k, v) for k, v in said.items()], "s string, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("want", decisions._has(F.try_parse_json("s"), "a").alias("got")).collect())


SCHEMA = "seq long, obj_id long, type string, t double, lon double, lat double, alt double, side string, launch boolean"


def flight(n, seed, objects=40, times=2000, places=None):
    r = random.Random(seed)
    at = places or [(r.uniform(0, 20), r.uniform(30, 45), r.uniform(0, 9000)) for _ in range(n)]
    return [(i, r.randrange(objects), r.choice(["Aircraft", "Aircraft", "Weapon"]), r.choice([r.uniform(0, times), float(r.randrange(0, times, 50))]), *r.choice(at), r.choice(["a", "b", None]), r.random() < 0.3) for i in range(n)]


def rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_cells_follow_the_density(spark):
    """More positions in the same place and time: smaller cells, so that a launch meets about as many; copies change nothing."""
    made = lambda n: spark.createDataFrame(flight(n, 3), SCHEMA)
    few, many = tracks.cells_for(made(400), 500.0), tracks.cells_for(made(6400), 500.0)
    assert 3 < few[0] / many[0] < 5 and list(many) == sorted(many)
    copied = made(400).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(15)))).withColumn("seq", F.col("seq") + 400 * F.col("copy")).drop("copy")
    assert tracks.cells_for(copied, 500.0) == few
    assert tracks.cells_for(made(400).limit(0), 500.0) == ()
    near = tracks.nearest_enemy(made(400), 500.0, cells=few)
    assert rows(near) == rows(tracks.nearest_enemy(made(400), 500.0))


def test_alike_positions_are_one(spark):
    """Positions of a side at one time and place: the first in the document stands for all of them."""
    data = [(0, 1, "Aircraft", 1.0, 5.0, 40.0, 9.0, "a", True), *[(i, i + 10, "Aircraft", 2.0, 5.5, 40.0, 9.0, "b", False) for i in range(50, 0, -1)]]
    df = spark.createDataFrame(data, SCHEMA)
    assert tracks._alike(tracks._positions(tracks.known(df), "e_", ("side",)), ("e_t", "e_seq")).count() == 2
    assert [r["enemy_id"] for r in tracks.nearest_enemy(df, 5.0).collect()] == [11]


def test_unknown_distances_come_last(spark):
    """An opposing position without altitude is nearer than none, and farther than any other."""
    data = [(0, 1, "Aircraft", 1.0, 5.0, 40.0, 9.0, "a", True), (1, 2, "Aircraft", 1.0, 5.0, 40.0, None, "b", False), (2, 3, "Aircraft", 1.0, 9.0, 40.0, 9.0, "b", False)]
    for n, want in ((3, 3), (2, 2)):
        df = spark.createDataFrame(data[:n], SCHEMA)
        for cells in ((), (1.0, 3.0)):
            assert [r["enemy_id"] for r in tracks.nearest_enemy(df, 5.0, cells=cells).collect()] == [want]


def by_hand(data, own_width, width):
    """Own positions around launches, each with all opposing objects near it: the nearest position and the first met."""
    first = {}
    for r in data:
        if r[2] == "Aircraft":
            first.setdefault(r[1], r)
    side = {o: r[7] for o, r in first.items()}
    places = [r for r in data if r[2] == "Aircraft"]
    out = {}
    for l in data:
        if l[8] and l[1] in first and first[l[1]][0] <= l[0]:
            own = {p[3]: p for p in places if p[1] == l[1] and abs(p[3] - l[3]) <= own_width}
            for t, p in own.items():
                out[l[0], t] = (p, {})
                for e in places:
                    if side[e[1]] != side[p[1]] and abs(e[3] - t) <= width:
                        out[l[0], t][1].setdefault(e[1], []).append(e)
    return out


def km(a, b):
    p, q, d = math.radians(a[5]), math.radians(b[5]), math.radians(b[4] - a[4])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(d / 2) ** 2
    return math.hypot(2 * 6371.0 * math.asin(min(1.0, math.sqrt(h))), (b[6] - a[6]) / 1000)


@pytest.mark.parametrize("salts", [1, 3])
def test_snapshots_and_states_by_hand(spark, salts):
    """Every object near an own position, times on the very edge too: counted, the nearest found, and each of them paired."""
    data = flight(250, 4, objects=12, times=2000) + [(250 + i, 100 + i % 2, "Aircraft", 0.1 + 150 * i, 5.0 + i, 40.0, 9.0, "ab"[i % 2], True) for i in range(8)]
    data.append((258, 200, "Aircraft", 99999.0, 5.0, 40.0, 9.0, "a", True))
    df = spark.createDataFrame(data, SCHEMA)
    want = by_hand(data, 300.0, 150.0)
    got = {(r["launch_seq"], r["t"]): r for r in tracks.states(df, 300.0, 150.0, cells=(0.5, 2.0)).collect()}
    assert got.keys() == want.keys() and any(not v[1] for v in want.values())
    for k, (p, enemies) in want.items():
        assert got[k]["enemies"] == len(enemies)
        best = min(((km(p, e), e[3], e[0], o) for o, es in enemies.items() for e in es), default=None)
        assert got[k]["enemy_id"] == (best and best[3]) and (best is None or abs(got[k]["dist"] - best[0]) < 1e-6)
    snaps = tracks.snapshots(df, 300.0, 150.0, salts=salts).collect()
    pairs = {(r["launch_seq"], r["t"], r["enemy_id"]): (round(r["dist"], 6), r["met_t"], r["met_seq"]) for r in snaps if r["enemy_id"] is not None}
    assert pairs == {(*k, o): (round(min(km(p, e) for e in es), 6), *min((e[3], e[0]) for e in es)) for k, (p, enemies) in want.items() for o, es in enemies.items()}
    assert sorted((r["launch_seq"], r["t"]) for r in snaps if r["enemy_id"] is None) == sorted(k for k, v in want.items() if not v[1])
    assert len(snaps) == len(pairs) + sum(not v[1] for v in want.values())


def test_reach_is_the_last_time_within(spark):
    """The ends of a span are the last numbers that the comparison takes, as it is computed."""
    r = random.Random(9)
    times = [0.1, 0.0, -7.3, 900.0, -900.0, *[r.uniform(-m, m) for m in (3e6, 2000.0, 1000.0) for _ in range(2000)], *[900 + round(r.uniform(0, 2000), 6) for _ in range(2000)]]
    df = spark.createDataFrame([(t,) for t in times], "t double").select("t", *[tracks._reach(F.col("t"), 900.0, up).alias(n) for n, up in (("hi", True), ("lo", False))])
    for x in df.collect():
        assert abs(x["hi"] - x["t"]) <= 900.0 < abs(math.nextafter(x["hi"], math.inf) - x["t"])
        assert abs(x["lo"] - x["t"]) <= 900.0 < abs(math.nextafter(x["lo"], -math.inf) - x["t"])


def test_pairs_are_not_shuffled(spark):
    """Pairs of own positions and objects are made by the last join: nothing is exchanged or sorted after it."""
    df = spark.createDataFrame(flight(50, 5), SCHEMA)
    plan = tracks.snapshots(df, 300.0, 150.0).where("enemy_id is not null")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    top = next(i for i, line in enumerate(plan) if "Join" in line)
    assert not any(word in line for line in plan[:top] for word in ("Aggregate", "Window", "Sort", "Repartition"))


def test_pairs_are_generated_code(spark):
    """Objects of one or two positions about a time: each pair is measured in a method small enough to be compiled, once for
    all launches that share the own position, and no list is searched for it."""
    df = spark.createDataFrame(flight(50, 5), SCHEMA)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stages = tracks.snapshots(df, 300.0, 150.0).where("enemy_id is not null").select("launch_seq", "t", "enemy_id", "dist", "brg")._jdf.queryExecution().debug().codegenToSeq()
        made = [(s._1(), s._3().maxMethodCodeSize()) for s in (stages.apply(i) for i in range(stages.size()))]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    above = [(p[: p.index("Join")], n) for p, n in made if "Join" in p]
    measured = [(p, n) for p, n in above if "ATAN2" in p and "ASIN" in p and "lambda" not in p]
    assert len(measured) == 2
    assert all("Generate explode" in p[: p.index("ATAN2")] and 0 < n < 8000 for p, n in measured)


@pytest.mark.parametrize("copies", [1, 2, 5])
def test_unknown_places_in_pairs(spark, copies):
    """One, two or more positions of an object: an unknown altitude is farther than any other, one that is no number is none."""
    nan, near = float("nan"), (2.0, 5.1, 40.0, 9.0, "b", False)
    own = (0, 1, "Aircraft", 1.0, 5.0, 40.0, 9.0, "a", True)
    for other, want in ((None, (2.0, 5.0)), (nan, (2.5, None))):
        rest = [(1 + i, 2, "Aircraft", 2.0 + 0.001 * i, 5.0, 40.0, other, "b", False) for i in range(copies)]
        alone = tracks.snapshots(spark.createDataFrame([own, *rest], SCHEMA), 5.0, 2.0).collect()
        assert [(r["enemy_id"], r["dist"], r["enemy_lon"], r["met_t"]) for r in alone] == [(2, None, *((5.0, 2.0) if other is None else (None, None)))]
        both = tracks.snapshots(spark.createDataFrame([own, *rest, (90, 2, "Aircraft", 2.5, *near[1:])], SCHEMA), 5.0, 2.0).collect()
        assert [(r["enemy_id"], r["enemy_lon"], r["met_t"], r["dist"] > 8) for r in both] == [(2, 5.1, want[0], True)]


def test_rounded_as_sql_rounds(spark):
    """Halves go away from zero, and what is no number stays."""
    import duckdb
    from contrail.functions import geo

    r = random.Random(2)
    numbers = [0.0, -0.0, 0.5, 2.5e-6, -2.5e-6, 1e300, -1e12, 359.9999995, *[r.uniform(-m, m) for m in (1e-5, 400.0, 3e6) for _ in range(2000)], *[r.randrange(-(10**9), 10**9) / 1e6 + 5e-7 for _ in range(2000)]]
    got = [x[0] for x in spark.createDataFrame([(x,) for x in numbers], "x double").select(geo.rounded(F.col("x"), 6)).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE n (i INT, x DOUBLE)")
    con.executemany("INSERT INTO n VALUES (?, ?)", list(enumerate(numbers)))
    assert got == [x[0] for x in con.execute("SELECT round(x, 6) FROM n ORDER BY i").fetchall()]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "x double").select(geo.rounded(F.col("x"), 6)).collect()
    assert math.isnan(odd[0][0]) and odd[1][0] == math.inf and odd[2][0] is None
