"""Stateful streams: frames out of packets, the action timeline, the newest row of each key."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from contrail.functions.control import RESET_AFTER

#: Seconds that actions must reach ahead for a decision to be skipped, and between two plans.
HORIZON, REFRESH = 3.0, 10.0
DEFAULT_PLAN = "保持编队并自保，必要时规避、占位。"


def _in_order(batches: Iterator[pd.DataFrame], order: str) -> pd.DataFrame:
    """One key's rows of a micro-batch, which the trigger bounds, in order of arrival."""
    return pd.concat(list(batches)).sort_values(order, kind="stable")


def reassemble(packets: DataFrame, key: str = "conn", order: str = "packet", data: str = "data") -> DataFrame:
    """``key, sim_time, vals`` of packets of token text. A token counts once white space follows it; what a packet leaves
    over waits, as the key's state, for the next."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text = (state.get[0] if state.exists else "") + "".join(_in_order(batches, "at")["data"].fillna(""))
        tokens = text.split()
        rest = [tokens.pop()] if tokens and not text[-1].isspace() else []
        times, vals, i = [], [], 0
        while i + 2 <= len(tokens) and i + 2 + (n := max(0, int(float(tokens[i + 1])))) <= len(tokens):
            times.append(float(tokens[i]))
            vals.append([float(x) for x in tokens[i + 2 : i + 2 + n]])
            i += 2 + n
        left = " ".join(tokens[i:])
        state.update(((left + " " if left else "") + "".join(rest),))
        yield pd.DataFrame({"key": k[0], "sim_time": times, "vals": vals})

    x = packets.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("at"), F.col(data).cast("string").alias("data"))
    return x.groupBy("key").applyInPandasWithState(run, "key string, sim_time double, vals array<float>", "rest string", "append", GroupStateTimeout.NoTimeout)


def act(frames: DataFrame, reset_after: float = RESET_AFTER, horizon: float = HORIZON, refresh: float = REFRESH) -> DataFrame:
    """``episode, seq, sim_time, message, action, plan`` for each frame.

    ``frames``: ``episode, seq`` (arrival), ``sim_time, plan``, and ``holds, actions`` that a decision gives at that frame
    (null without one, or where it failed: actions stay as they are, a new plan is taken). The frame is answered by the step that its time
    falls into, else by the last action; then its decision, unless actions reach ``horizon`` seconds ahead, is appended to
    unfinished steps or replaces finished ones, with ends counted from the frame's time. A frame after ``reset_after`` is
    answered RESET and changes nothing. ``plan`` is the one held, refreshed when no step is active, by one not blank.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ends, queue, last, plan, planned = ([list(x) if isinstance(x, list | tuple) else x for x in state.get]) if state.exists else ([], [], [], None, None)
        queue, out = [list(q) for q in queue], []
        for r in _in_order(batches, "seq").itertuples(index=False):
            t = float(r.sim_time)
            if t > reset_after:
                out.append((k[0], r.seq, t, "RESET", None, None))
                continue
            while ends and t > ends[0]:
                ends, queue = ends[1:], queue[1:]
            last = queue[0] if queue else last
            out.append((k[0], r.seq, t, "STATUS", list(last), plan or DEFAULT_PLAN))
            active = ends[-1] if ends else float("-inf")
            if active >= t + horizon:
                continue
            if active <= t and refresh > 0 and (planned is None or t - planned >= refresh) and isinstance(r.plan, str) and r.plan.strip():
                plan, planned = r.plan.strip(), t
            if r.holds is None or r.actions is None:
                continue
            at, steps = t, []
            for hold in r.holds:
                at += float(hold)
                steps.append(at)
            steps_actions = [[float(x) for x in a] for a in r.actions]
            ends, queue = (ends + steps, queue + steps_actions) if active > t else (steps, steps_actions)
            last = queue[0] if queue else last
        state.update((ends, queue, last, plan, planned))
        yield pd.DataFrame(out, columns=["episode", "seq", "sim_time", "message", "action", "plan"])

    x = frames.select(F.col("episode").cast("string").alias("episode"), F.col("seq").cast("long").alias("seq"), F.col("sim_time").cast("double").alias("sim_time"), "plan", F.col("holds").cast("array<double>").alias("holds"), F.col("actions").cast("array<array<double>>").alias("actions"))
    x = x.where("sim_time is not null")
    return x.groupBy("episode").applyInPandasWithState(
        run,
        "episode string, seq long, sim_time double, message string, action array<double>, plan string",
        "ends array<double>, queue array<array<double>>, last array<double>, plan string, planned double",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def newest(batch: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key: for ``foreachBatch``, so that a slow consumer sees the latest state alone."""
    return batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")


def run_paced(stream: DataFrame, handle: Callable[[DataFrame, int], None], seconds: float = 0.5, rounds: int = 5, timeout: float = 60.0) -> int:
    """Give ``handle`` the stream's micro-batches at a fixed rate, ``rounds`` of them at most; returns how many it had."""
    done: list[int] = []

    def one(batch: DataFrame, number: int) -> None:
        if len(done) < rounds:
            handle(batch, number)
            done.append(number)

    query = stream.writeStream.foreachBatch(one).trigger(processingTime=f"{int(seconds * 1000)} milliseconds").start()
    until = time.monotonic() + timeout
    try:
        while len(done) < rounds and time.monotonic() < until and query.isActive:
            query.awaitTermination(seconds)
    finally:
        query.stop()
    return len(done)
