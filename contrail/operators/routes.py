"""Rows that go from node to node: a loop of bounded rounds, and the planner and executor of a plan on it.

A node is a function from a DataFrame to a DataFrame, such as a call of a model; a route names the node that comes next,
from the columns of a row. In each round the rows that have a next node are split by it, each node runs once over all its
rows, and the rows without a next node leave. A round's rows are written to a table in the shared folder, so no node runs
twice for a row and no plan grows with the rounds; a round writes only what is still under way.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.functions import decisions, text

Node = Callable[[DataFrame], DataFrame]


def _written(x: DataFrame) -> DataFrame:
    """``x`` as a table in the folder of ``spark.checkpoint.dir``; a session on one machine that names none uses /tmp."""
    spark = x.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "/tmp/checkpoints/contrail"
    path = f"{folder.rstrip('/')}/contrail-{uuid.uuid4().hex}"
    x.write.parquet(path)
    return spark.read.schema(x.schema).parquet(path)


def run(rows: DataFrame, nodes: dict[str, Node], routes: dict[str, Column], entry: Column | str, limit: int = 10) -> DataFrame:
    """The columns of ``rows`` after their way through the nodes, with ``path`` (names of the nodes, in order) and ``ended``.

    ``entry``: the first node, by name or as a column. ``routes``: for each node what comes after it; a node without a
    route is a last one. A name that is no node's, and null, end the way. A row that has a next node after ``limit`` nodes
    stays as it is then, and ``ended`` is false. Nodes keep all columns they are given; columns they add are dropped, rows
    they drop leave. An empty table ends at once. A column ``path``, ``next`` or ``ended`` in ``rows`` is an error.
    """
    if clash := {"path", "next", "ended"} & set(rows.columns):
        raise ValueError(f"columns {sorted(clash)} are the loop's own")
    if unknown := set(routes) - set(nodes):
        raise ValueError(f"routes from {sorted(unknown)}, which are no nodes")
    columns = rows.columns
    to = lambda c: F.when(c.isin(*nodes), c)
    first = F.lit(entry) if isinstance(entry, str) else entry
    x = rows.withColumn("path", F.array().cast("array<string>")).withColumn("next", to(first))
    left = []
    for _ in range(limit):
        left.append(x.where("next is null"))
        parts = []
        for name, node in nodes.items():
            after = to(routes[name]) if name in routes else F.lit(None).cast("string")
            been = F.array_append("path", F.lit(name))
            parts.append(node(x.where(F.col("next") == name)).select(*columns, been.alias("path"), after.alias("next")))
        x = _written(reduce(DataFrame.unionByName, parts))
        if x.where("next is not null").isEmpty():
            break
    return reduce(DataFrame.unionByName, [*left, x]).select(*columns, "path", F.col("next").isNull().alias("ended"))


def _planned(planner: Node, mode: str) -> Node:
    """The planner's node: what it says in ``raw`` becomes ``decision``, ``plan`` and, of an answer, ``result``."""

    def node(x: DataFrame) -> DataFrame:
        said = planner(x).withColumn("said", decisions.planner_decision(F.col("raw"), mode))
        return said.withColumns({"decision": F.col("said.decision"), "plan": F.col("said.plan"), "result": F.coalesce("said.result", "result")}).drop("said")

    return node


def _state(rows: DataFrame) -> DataFrame:
    """Rows with the columns of a plan's state; those that are not given are null."""
    return rows.withColumns({c: F.lit(None).cast("string") for c in ("plan", "raw", "decision", "result") if c not in rows.columns})


def planner_only(rows: DataFrame, planner: Node, mode: str = "plan") -> DataFrame:
    """Each row's ``raw``, ``decision`` and ``plan`` from the planner; ``mode`` as in ``decisions.planner_decision``."""
    return _planned(planner, mode)(_state(rows))


def executor_only(rows: DataFrame, executor: Node) -> DataFrame:
    """Each row's ``result`` from the executor, under the plan it has."""
    return executor(_state(rows))


def plan_and_execute(rows: DataFrame, planner: Node, executor: Node, mode: str = "plan") -> DataFrame:
    """Rows whose ``plan`` is blank get one from the planner; rows with a plan, and those that it decides to execute, get
    their ``result`` from the executor. ``path`` tells who ran."""
    routes = {"planner": F.when(F.col("decision") == "execute", "executor")}
    nodes = {"planner": _planned(planner, mode), "executor": executor}
    return run(_state(rows), nodes, routes, F.when(text.not_blank(F.col("plan")), "executor").otherwise("planner"), limit=2).drop("ended")
