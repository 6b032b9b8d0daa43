"""Greedy packing of ordered texts into sequences of a token budget, without a task that holds the order.

Texts are taken in order; one that is longer than the budget is cut into pieces of it. A piece that fits goes into the open
pack, any other begins a new one. With offsets from running sums (a segmented scan), a piece j begins a pack exactly if it
ends more than the budget after the last pack's begin, so what a stretch of pieces does depends on the last begin before
it only by its first own begin, which is one of the pieces that end within a budget of its start or the next one.

1. Blocks of many budgets of tokens: each gives a small table, from the first begin to the last begin and the number of packs.
2. Tables of neighbouring blocks are put together by groups; the groups' tables, which are few, are followed in order by one
   task, so that each group, and then each block in it, knows the begin of the pack that is open before it.
3. Each block then names its pieces' packs.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.operators import scans

#: Budgets of a block, and blocks of a group.
SPAN, GROUP = 64, 1024

_TABLE = "block long, first long, ends array<long>, last array<long>, packs array<long>"


def table_of(start: np.ndarray, end: np.ndarray, budget: int) -> tuple[list, list, list]:
    """Of a block's pieces, in order: the ends of those that may begin its first pack, the last begin then, how many packs."""
    entries = min(int(np.searchsorted(end, start[0] + budget, "right")) + 1, len(end))
    following = np.searchsorted(end, start + budget, "right")  # the piece that begins the pack after one that begins here
    last, packs = np.arange(len(end)), np.ones(len(end), np.int64)
    for j in range(len(end) - 1, -1, -1):
        if following[j] < len(end):
            last[j], packs[j] = last[following[j]], packs[following[j]] + 1
    return end[:entries].tolist(), start[last[:entries]].tolist(), packs[:entries].tolist()


def after(state: tuple[int | None, int], ends: list, last: list, packs: list, budget: int) -> tuple[int | None, int]:
    """(begin of the open pack, packs so far) after a stretch; a begin of None: no pack is open yet."""
    i = 0 if state[0] is None else bisect_left(ends, state[0] + budget + 1)
    return (last[i], state[1] + packs[i]) if i < len(ends) else state


def joined(tables: list[tuple], budget: int) -> tuple[list, list, list]:
    """The table of neighbouring stretches (first, ends, last, packs)."""
    first, out = tables[0][0], ([], [], [])
    for k, (_, ends, last, packs) in enumerate(tables):
        for e, l, p in zip(ends, last, packs, strict=True):
            state = (l, p)
            for _, *rest in tables[k + 1 :]:
                state = after(state, *rest, budget)
            for column, v in zip(out, (e, *state), strict=True):
                column.append(v)
            if e > first + budget:
                return out
    return out


def pieces(texts: DataFrame, order: str, tokens: str, budget: int) -> DataFrame:
    """``order, piece, n``: texts in pieces of at most the budget; one without tokens is an empty piece."""
    n = F.coalesce(F.col(tokens).cast("long"), F.lit(0).cast("long"))
    cut = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(n / budget) - 1, F.lit(0)))
    x = texts.select(F.col(order).alias("order"), n.alias("all"), F.explode(cut).alias("piece"))
    return x.select("order", "piece", F.least(F.col("all") - F.col("piece") * budget, F.lit(budget)).cast("long").alias("n"))


def pack(texts: DataFrame, order: str, tokens: str, budget: int = 4096, block: Column | None = None) -> DataFrame:
    """``order, piece, n, pack, place``: the pack of each piece, from 0, and the tokens before it there.

    ``order``: a whole number that each text has once. ``block``: see ``scans.scan``, of the column ``order``.
    """
    cut = pieces(texts, order, tokens, budget)
    start = scans.Running("sum", F.col("n"), inclusive=False)
    x = scans.scan(cut, [], ["order", "piece"], block if block is not None else scans.blocks_of("order"), levels=1, start=start)
    x = x.withColumn("end", F.col("start") + F.col("n")).withColumn("block", F.floor(F.col("start") / (SPAN * budget)))

    def table(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["order", "piece"])
        s, e = p["start"].to_numpy(), p["end"].to_numpy()
        ends, last, packs = table_of(s, e, budget)
        return pd.DataFrame({"block": [p["block"].iloc[0]], "first": [s[0]], "ends": [ends], "last": [last], "packs": [packs]})

    tables = x.groupBy("block").applyInPandas(table, _TABLE).withColumn("group", F.floor(F.col("block") / GROUP))
    rows = lambda p: list(zip(p["first"].tolist(), *[[list(v) for v in p[c]] for c in ("ends", "last", "packs")], strict=True))

    def together(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("block")
        ends, last, packs = joined(rows(p), budget)
        return pd.DataFrame({"block": [p["group"].iloc[0]], "first": [p["first"].iloc[0]], "ends": [ends], "last": [last], "packs": [packs]})

    def followed(p: pd.DataFrame, state: tuple[int | None, int]) -> pd.DataFrame:
        p, opened, before = p.sort_values("block"), [], []
        for _, *t in rows(p):
            opened.append(state[0])
            before.append(state[1])
            state = after(state, *t, budget)
        return pd.DataFrame({"block": p["block"], "opened": pd.array(opened, "Int64"), "before": before})

    groups = tables.groupBy("group").applyInPandas(together, _TABLE)
    known = groups.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(lambda p: followed(p, (None, 0)), "block long, opened long, before long")
    met = tables.join(known.select(F.col("block").alias("group"), "opened", "before"), "group")
    none = lambda v: None if pd.isna(v) else int(v)
    entered = met.groupBy("group").applyInPandas(lambda p: followed(p, (none(p["opened"].iloc[0]), int(p["before"].iloc[0]))), "block long, opened long, before long")

    def named(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["order", "piece"])
        s, e = p["start"].to_numpy(), p["end"].to_numpy()
        opened, number = none(p["opened"].iloc[0]), int(p["before"].iloc[0]) - 1
        pack_, place, at = np.empty(len(p), np.int64), np.empty(len(p), np.int64), 0
        while at < len(p):
            to = len(p)
            if opened is not None:
                to = int(np.searchsorted(e, opened + budget, "right"))
                pack_[at:to], place[at:to] = number, s[at:to] - opened
            else:
                to = at
            at = to
            if at < len(p):
                opened, number = int(s[at]), number + 1
        return pd.DataFrame({"order": p["order"], "piece": p["piece"], "n": p["n"], "pack": pack_, "place": place})

    kind = texts.schema[order].dataType.simpleString()
    return x.join(entered, "block").groupBy("block").applyInPandas(named, f"order {kind}, piece long, n long, pack long, place long")
