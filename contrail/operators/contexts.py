"""Command lines of contexts by rule: intent of the plan, bearing to the first blue, altitude."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.functions import decisions, geo, text


def command_lines(units: DataFrame, plans: DataFrame) -> DataFrame:
    """``ctx, line`` for each row of ``plans`` (``ctx, plan``): the commands of its red units in their order.

    ``units``: ``ctx, side, n, heading, x, y, z``; n numbers a side's units from 1. On an intercept a red unit turns to the
    first blue, if there is one; on a retreat it turns by 60. Units without a command are left out. A context has as many
    units as a frame, so its line is collected.
    """
    first = units.where("side = 'blue' and n = 1").select("ctx", F.col("x").alias("bx"), F.col("y").alias("by"))
    red = units.where("side = 'red'").join(first, "ctx", "left").join(plans.select("ctx", text.intent(F.col("plan")).alias("intent")), "ctx")
    to_blue = F.coalesce(geo.turn_command(F.col("heading"), geo.planar_bearing_deg(F.col("x"), F.col("y"), F.col("bx"), F.col("by"))), F.lit(""))
    turn = F.when(F.col("intent") == "retreat", "turn 60").when((F.col("intent") == "intercept") & F.col("bx").isNotNull(), to_blue).otherwise("")
    said = F.trim(F.concat_ws(" ", turn, geo.altitude_command(F.col("z"), F.col("intent") == "climb")))
    told = red.select("ctx", "n", said.alias("a")).where("a <> ''").groupBy("ctx").agg(F.array_sort(F.collect_list(F.struct("n", F.concat(F.lit("red"), F.col("n").cast("string"), F.lit(" "), F.col("a")).alias("c")))).alias("x"))
    return plans.select("ctx").join(told, "ctx", "left").select("ctx", F.concat(F.lit("##"), F.coalesce(F.array_join("x.c", " "), F.lit("")), F.lit("##")).alias("line"))


def execute(rows: DataFrame, ctx: str = "ctx", context: str = "context", plan: str = "plan") -> DataFrame:
    """``ctx, line`` for each row: the commands of a plan for the units that a context's text lists.

    A null context has no units, a null plan is an intercept; a context named twice is one context only if all rows of the
    name are equal, so names should be unique.
    """
    given = rows.select(F.col(ctx).alias("ctx"), F.col(context).alias("context"), F.col(plan).alias("plan"))
    units = given.select("ctx", F.explode(decisions.context_units(F.col("context"))).alias("u")).select("ctx", "u.*")
    return command_lines(units.withColumn("n", F.regexp_extract("unit", "[0-9]+$", 0).cast("int")), given.select("ctx", "plan"))
