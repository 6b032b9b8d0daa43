"""Refresh gates and message numbers: nothing of a key's size in one array; odd rows."""

from pyspark.sql import functions as F

from contrail.operators import gates
from contrail.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_no_arrays_of_whole_keys(spark):
    plan = QUERIES["chat_messages"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def test_gate_across_batches_and_nulls(spark):
    many = spark.range(50_000).select(F.lit(2**60 + 1).alias("k"), (F.col("id") * 0.25).alias("t"))
    few = spark.createDataFrame([(1, 5.0), (1, None), (1, 0.0), (1, 10.0), (1, 14.9), (2, None), (None, 3.0), (None, 3.0)], "k long, t double")
    got = {r["k"]: (r["n"], r["last_t"]) for r in gates.refresh_gate(many.union(few), "k", "t", 10.0).collect()}
    assert got == {2**60 + 1: (1250, 12490.0), 1: (2, 10.0), 2: (0, None), None: (1, 3.0)}
    assert gates.refresh_gate(few.limit(0), "k", "t", 10.0).count() == 0
