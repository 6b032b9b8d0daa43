"""The loop of nodes against a Python fold, the limit, entries, and plans by planner and executor."""

import pytest
from pyspark.sql import functions as F

from contrail.operators import routes

UP = {"double": lambda x: x.withColumn("n", F.col("n") * 2), "less": lambda x: x.withColumn("n", F.col("n") - 1).withColumn("more", F.lit(1))}


def up_route():
    return F.when(F.col("n") > 50, "FINISH").when(F.col("n") % 3 == 0, "less").when(F.col("n").isNotNull(), "double")


def fold(n, entry, limit):
    def route(n):
        return None if n is None or n > 50 else "less" if n % 3 == 0 else "double"

    path, at = [], entry or route(n)
    while at and len(path) < limit:
        n = None if n is None else n * 2 if at == "double" else n - 1
        path.append(at)
        at = route(n)
    return n, path, at is None


@pytest.mark.parametrize("entry, limit", [(None, 10), (None, 3), ("less", 10), ("double", 1), (None, 0)])
def test_loop_against_fold(spark, entry, limit):
    given = [0, 1, 2, 3, 7, 9, 26, 49, 51, 200, None, 7]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(given)], "id int, n long")
    got = routes.run(df, UP, {"double": up_route(), "less": up_route()}, entry or up_route(), limit)
    assert got.columns == ["id", "n", "path", "ended"]
    want = [(i, *fold(n, entry, limit)) for i, n in enumerate(given)]
    assert sorted(map(tuple, got.collect())) == want
    if entry is None and limit == 3:
        assert {len(w[2]) for w in want if w[3]} >= {0, 1, 3} and not all(w[3] for w in want)


def test_rounds_hold_what_is_under_way_and_nodes_run_once(spark):
    ran = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            ran.add(len(b))
            yield b.assign(n=b["n"] + 1)

    df = spark.range(100).select((F.col("id") % 4).alias("n"))
    step = F.when(F.col("n") < 4, "up")
    got = routes.run(df, {"up": lambda x: x.mapInPandas(count, x.schema)}, {"up": step}, step)
    assert got.where("ended and n = 4").count() == 100 and got.count() == 100
    assert ran.value == 25 * (4 + 3 + 2 + 1)


def test_supervisor_with_specialists(spark):
    """The supervisor goes first, then to one specialist after the other, then ends."""
    said = lambda who, then: lambda x: x.withColumns({"log": F.array_append("log", F.lit(who)), "to": F.lit(then)})
    nodes = {"supervisor": lambda x: x.withColumn("to", F.coalesce("to", F.lit("researcher"))), "researcher": said("[researcher]", "coder"), "coder": said("[coder]", "FINISH")}
    after = {"supervisor": F.col("to"), "researcher": F.lit("supervisor"), "coder": F.lit("supervisor")}
    df = spark.createDataFrame([("a", [], None), ("b", [], "coder"), ("c", [], "nobody")], "task string, log array<string>, to string")
    got = {r["task"]: (r["path"], r["log"], r["ended"]) for r in routes.run(df, nodes, after, "supervisor").collect()}
    assert got["a"] == (["supervisor", "researcher", "supervisor", "coder", "supervisor"], ["[researcher]", "[coder]"], True)
    assert got["b"] == (["supervisor", "coder", "supervisor"], ["[coder]"], True)
    assert got["c"] == (["supervisor"], [], True)


def test_empty_table_and_errors(spark):
    df = spark.createDataFrame([(1, 1)], "id int, n long")
    assert routes.run(df.limit(0), UP, {"double": up_route()}, up_route()).count() == 0
    with pytest.raises(ValueError, match="path"):
        routes.run(df.withColumn("path", F.lit(1)), UP, {}, "less")
    with pytest.raises(ValueError, match="other"):
        routes.run(df, UP, {"other": up_route()}, "less")


def test_plans(spark):
    say = lambda x: x.withColumn("raw", F.col("context"))
    act = lambda x: x.withColumn("result", F.concat_ws("|", "plan", "context"))
    rows = [(1, '{"plan": "go"}', None), (2, '{"plan": "go"}', "stay"), (3, "no json", " \n"), (4, '{"action": "end", "answer": "x"}', ""), (5, None, None)]
    df = spark.createDataFrame(rows, "id int, context string, plan string")
    got = {r["id"]: (r["path"], r["plan"], r["result"]) for r in routes.plan_and_execute(df, say, act, "route").collect()}
    both = ["planner", "executor"]
    assert got[1] == (both, "go", 'go|{"plan": "go"}')
    assert got[2] == (["executor"], "stay", 'stay|{"plan": "go"}')
    assert got[3][0] == both and got[3][1].endswith("no json")
    assert got[4] == (["planner"], None, "x")
    assert got[5][0] == both
    only = {r["id"]: (r["decision"], r["plan"], r["result"]) for r in routes.planner_only(df, say).collect()}
    assert only[1] == ("execute", "go", None) and only[3] == ("execute", "no json", None)
    done = {r["id"]: r["result"] for r in routes.executor_only(df, act).collect()}
    assert done[2] == 'stay|{"plan": "go"}' and done[5] == ""
