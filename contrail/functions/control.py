"""Decisions, action scaling, step budgets and refresh gates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full scale of turn (deg), climb (m) and speed change (m/s); step cap, time budget and default hold (s).
TURN, CLIMB, SPEED = 45.0, 2000.0, 150.0
MAX_STEPS, MAX_TOTAL, HOLD = 12, 15.0, 1.0
RESET_AFTER = 5000.0


def clamp(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """Limited to low..high; NaN stays NaN."""
    return F.when(F.isnan(x), x).when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def budget_fold(holds: Column, max_steps: int = MAX_STEPS, max_total: float = MAX_TOTAL) -> Column:
    """The holds that are executed: cut to the step cap, non-positive ones skipped, ended by the first overrun."""
    steps = F.slice(holds, 1, max_steps) if max_steps > 0 else holds
    start = F.struct(F.array().cast("array<double>").alias("out"), F.lit(0.0).alias("t"), F.lit(False).alias("done"))

    def step(s: Column, h: Column) -> Column:
        over = s["done"] | (s["t"] + h > max_total)
        skip = h <= 0
        return F.when(skip, s).when(over, s.withField("done", F.lit(True))).otherwise(F.struct(F.concat(s["out"], F.array(h)).alias("out"), (s["t"] + h).alias("t"), s["done"].alias("done")))

    return F.aggregate(steps, start, step, lambda s: s["out"])


def status(sim_time: Column, reset_after: float = RESET_AFTER) -> Column:
    """RESET after the threshold, else STATUS."""
    return F.when(sim_time > reset_after, "RESET").otherwise("STATUS")
