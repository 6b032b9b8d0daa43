"""The action timeline in batch: which step of the decisions so far answers a frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrail.operators import scans


def step_intervals(decisions: DataFrame) -> DataFrame:
    """``episode, decided, step, from_t, until_t, action`` of ``episode, t, holds, actions``, one row for each step.

    A step ends its decision's time and all holds up to it later. A decision is appended if the last step of the decision
    before ends after its time, else it replaces all that is left. A step answers frames after ``from_t`` up to
    ``until_t``: from the end of all steps before it in the queue (or its decision), until its own end or the decision that
    replaces it; a step that never does so has none.
    """
    order = Window.partitionBy("episode").orderBy("t")
    ends = F.transform("holds", lambda _, i: F.aggregate(F.slice("holds", F.lit(1), i + 1), F.col("t").cast("double"), lambda a, h: a + h))
    x = decisions.where(F.size("holds") > 0).select("episode", F.col("t").cast("double").alias("t"), "holds", "actions").withColumn("ends", ends)
    x = x.withColumn("fresh", F.coalesce(F.lag(F.element_at("ends", -1)).over(order) <= F.col("t"), F.lit(True)))
    x = x.withColumn("queue", F.sum(F.col("fresh").cast("long")).over(order))
    queues = Window.partitionBy("episode").orderBy("queue")
    starts = x.where("fresh").select("episode", "queue", F.lead("t").over(queues).alias("replaced"))
    x = x.join(starts, ["episode", "queue"])
    each = x.select("episode", "queue", "t", "replaced", F.posexplode(F.arrays_zip(F.col("ends").alias("end"), F.col("actions").alias("action"))).alias("step", "s"))
    ahead = Window.partitionBy("episode", "queue").orderBy("t", "step").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("from_t", F.greatest(F.max("s.end").over(ahead), F.col("t"))).withColumn("until_t", F.least("s.end", "replaced"))
    return each.where("until_t > from_t").select("episode", F.col("t").alias("decided"), "step", "from_t", "until_t", F.col("s.action").alias("action"))


def answered(frames: DataFrame, decisions: DataFrame, none: Column, span: float = 3600.0) -> DataFrame:
    """``episode, seq, t, status, action`` for each frame (``episode, seq, t``) under the decisions (see ``step_intervals``).

    ``active``: the step that the frame falls into, a decision at the frame's own time not yet counted. ``held``: none is
    left, so the last action that answered a frame, or that a replacing decision began with, stays. ``none``: there was
    none yet, and the action is the given one. ``span``: seconds of an episode that one task scans.
    """
    steps = step_intervals(decisions)
    first = steps.where("step = 0 and from_t = decided")
    # in one order of time: where steps begin (after frames of that time) and frames
    begin = steps.select("episode", F.col("from_t").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("seq"), F.struct("until_t", "action").alias("step"), F.lit(None).cast(first.schema["action"].dataType).alias("set"))
    sets = first.select("episode", F.col("decided").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast(begin.schema["step"].dataType).alias("step"), F.col("action").alias("set"))
    asked = frames.select("episode", F.col("t").cast("double").alias("t"), F.lit(0).alias("kind"), F.col("seq").cast("long").alias("seq"), F.lit(None).cast(begin.schema["step"].dataType).alias("step"), F.lit(None).cast(first.schema["action"].dataType).alias("set"))
    order, block = ["t", "kind", "seq"], scans.blocks_of("t", span)
    x = scans.scan(begin.union(sets).union(asked), ["episode"], order, block, last=scans.Running("last", F.col("step")))
    x = x.withColumn("active", F.when((F.col("kind") == 0) & (F.col("t") <= F.col("last.until_t")), F.col("last.action")))
    x = scans.scan(x, ["episode"], order, block, held=scans.Running("last", F.coalesce("active", "set"))).where("kind = 0")
    status = F.when(F.col("active").isNotNull(), "active").when(F.col("held").isNotNull(), "held").otherwise("none")
    return x.select("episode", "seq", "t", status.alias("status"), F.coalesce("held", none).alias("action"))
