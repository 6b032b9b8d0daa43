"""Command lines against the golden contexts of FIXTURES.md 1.7."""

from pyspark.sql import functions as F

from contrail.functions import decisions
from contrail.operators import contexts
from contrail.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def unit(x, y, z, h=0):
    return f"{{'state': {{'heading': {h}, 'position': ({x}, {y}, {z}), 'speed': 300}}}}"


def frame(red, blue):
    return "\n".join([decisions.RED, *red, decisions.BLUE, *blue])


def test_golden_lines(spark):
    first = frame([unit(0.0, 0.0, 5000)], [unit(5000.0, 5000.0, 5000, 180)])
    left = frame([unit(0.0, 0.0, 5000)], [unit(-5000.0, 5000.0, 5000, 180)])
    two = frame([unit(5000, 20000, 500), unit(5000, 35000, 500)], [unit(45000, 25000, 500), unit(45000, 30000, 500)])
    none = frame([unit(0.0, 0.0, 5000)], [])
    cases = [(first, "intercept", "##red1 turn 30##"), (left, "intercept", "##red1 turn -30##"), (two, "intercept", "##red1 turn 60 up 100 red2 turn 60 up 100##"), (first, "retreat", "##red1 turn 60##"), (first, "climb", "##red1 up 100##"), (none, "intercept", "####")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "ctx long, text string, plan string, want string")
    units = df.select("ctx", F.explode(decisions.context_units(F.col("text"))).alias("u")).select("ctx", "u.*").withColumn("n", F.regexp_extract("unit", "[0-9]+", 0).cast("int"))
    got = contexts.command_lines(units, df.select("ctx", "plan")).join(df, "ctx")
    assert got.count() == len(cases)
    assert all(r["line"] == r["want"] for r in got.collect())


def test_contexts_cover_all_events(spark):
    ids = spark.read.parquet(f"{SF}/events.parquet").select(F.floor(F.col("event_id") / 20).alias("ctx")).distinct()
    assert QUERIES["bvr_context_command_line"](spark, SF).join(ids, "ctx").count() == ids.count()


def test_units_in_all_spellings(spark):
    """What is a dictionary takes a number of its side, whatever its quotes and brackets; what is none takes no number."""
    cases = [
        (unit(1.5, -2, 3), ("red1", 0.0, 1.5, -2.0, 3.0)),
        ("unit A: {\"state\": {\"heading\": 10, \"position\": [4, 5., +6e1], }} .", ("red2", 10.0, 4.0, 5.0, 60.0)),
        ("{'state': {'heading': 10, 'position': (1, 2, 3)}", None),
        ("{'state', 'heading'}", None),
        ("{'state': {'heading': 10, 'position': (1, 2, 3]}}", None),
        ("{'name': 'it\\'s', 'state': {'position': (7, 8)}}", ("red3", None, 7.0, 8.0, None)),
        ("{'other': None}", ("red4", None, None, None, None)),
        ("[1, 2]", None),
        (unit(9, 9, 9, 45), ("red5", 45.0, 9.0, 9.0, 9.0)),
    ]
    text = "\n".join(["before any side: {'state': {}}", decisions.RED, *[c for c, _ in cases], decisions.BLUE, unit(0, 0, 1)])
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, s string")
    got = {r["id"]: r["u"] for r in df.select("id", decisions.context_units(F.col("s")).alias("u")).collect()}
    assert [(u["unit"], u["heading"], u["x"], u["y"], u["z"]) for u in got[1]] == [w for _, w in cases if w] + [("blue1", 0.0, 0.0, 0.0, 1.0)]
    assert not got[2] and got[3] == []


def test_usual_spelling_equals_the_grammar(spark):
    """The same numbers, whether a line is in the usual spelling or, by one more blank, goes through the grammar."""
    numbers = ["0", "-0.0", "12", "-7.25", "1e3", "2.5E-2", "123456789012", "0.1"]
    lines = [f"{{'state': {{'heading': {a}, 'position': ({b}, {a}, {b}), 'speed': {b}}}}}" for a in numbers for b in numbers]
    texts = ["\n".join([decisions.RED, *x]) for x in (lines, [v.replace("{'state'", "{ 'state'") for v in lines])]
    got = [r["u"] for r in spark.createDataFrame([(v,) for v in texts], "s string").select(decisions.context_units(F.col("s")).alias("u")).collect()]
    assert got[0] == got[1] and len(got[0]) == len(lines)
    assert all(u["x"] is not None and u["speed"] is not None for u in got[0])
