"""Refresh gates: which times a key accepts, the first and then each at least an interval after the last accepted.

What a gate does with a stretch of times depends on the last accepted time before it in one way only: by the first time of
the stretch that it accepts, and that is one of the few that lie less than an interval after the stretch's first, or the next
one. So a stretch is a small table, from the first accepted time to the last one and their number, and neighbouring
stretches' tables are put together to one. A key's times are cut into blocks of many intervals, each block gives its table,
tables are put together in groups of blocks, and only the last step, over a few tables, is one row of a key.

In a block every time has a pointer to the time that would be accepted next, which one sort gives: times and times plus an
interval in falling order, counting times. A chain of pointers is then as long as the block has intervals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Intervals of a block, and blocks of a group.
SPAN, GROUP = 64, 64

#: Of a block (z: falling times t and pointers c) each time that may be accepted first, in rising order, with the last accepted
#: time and the number. A pointer c is the 1-based place of the next accepted time, 0 for none; it may be a few roundings
#: early, so the difference of the times decides, and rarely a later place is looked at.
_TABLE = """transform(array(struct(x.t AS t, x.c AS c)), z -> IF(size(z.t) = 0, array(),
    transform(sequence(size(z.t), greatest(size(z.t) - size(filter(z.t, t -> t - z.t[size(z.t) - 1] < {interval})), 1), -1), f ->
        aggregate(sequence(0, {span}), struct(f AS i, 1L AS n, z.c[f - 1] AS c),
            (s, k) -> IF(s.c = 0, s, transform(array(CASE WHEN z.t[s.c - 1] - z.t[s.i - 1] >= {interval} THEN s.c WHEN s.c = 1 THEN 0 WHEN z.t[s.c - 2] - z.t[s.i - 1] >= {interval} THEN s.c - 1
                ELSE coalesce(get(filter(sequence(s.c, 1, -1), j -> z.t[j - 1] - z.t[s.i - 1] >= {interval}), 0), 0) END),
                j -> IF(j = 0, struct(s.i AS i, s.n AS n, 0 AS c), struct(j AS i, s.n + 1L AS n, z.c[j - 1] AS c)))[0]),
            s -> struct(z.t[f - 1] AS t, z.t[s.i - 1] AS last, s.n AS n)))))[0]"""

#: Of neighbouring stretches (x: their tables) one table: of all times that may be accepted first, those less than an interval
#: after the first and the next one, each followed through the stretches after its own. In a stretch the first time that is
#: far enough after the last accepted one counts, if there is any.
_JOINED = """transform(slice(every, 1, size(filter(every, e -> e.t - every[0].t < {interval})) + 1), e ->
    aggregate(slice(x, e.j + 2, size(x)), struct(e.last AS last, e.n AS n),
        (s, y) -> transform(array(get(filter(y, a -> a.t - s.last >= {interval}), 0)), a -> IF(a IS NULL, s, struct(a.last AS last, s.n + a.n AS n)))[0],
        s -> struct(e.t AS t, s.last AS last, s.n AS n)))"""


def _joined(tables: DataFrame, keys: list[str], interval: float) -> DataFrame:
    """Tables of neighbouring stretches (``b, y``) put together to one for each group."""
    x = tables.groupBy(*[F.expr(k) for k in keys]).agg(F.array_sort(F.collect_list(F.struct("b", "y"))).alias("x"))
    x = x.select(*[k.rpartition(" ")[2] for k in keys], F.expr("filter(x.y, y -> size(y) > 0) AS x"))
    x = x.select("*", F.expr("flatten(transform(x, (y, j) -> transform(y, e -> struct(e.t AS t, j AS j, e.last AS last, e.n AS n)))) AS every"))
    return x.select(*[k.rpartition(" ")[2] for k in keys], F.expr(f"IF(size(every) = 0, array(), {_JOINED.format(interval=interval)}) AS y"))


def refresh_gate(rows: DataFrame, key: str, time: str, interval: float) -> DataFrame:
    """``key, n, last_t``: how many times each key accepts, and the last of them; 0 and null for a key without times.

    A null key is a key; null times and those that are no number are not times.
    """
    if interval <= 0:
        raise ValueError("the interval must be positive")
    at = f"{float(interval)!r}D"
    t = F.col(time).cast("double")
    x = rows.select(F.struct(F.col(key).alias("key")).alias("k"), F.when(~F.isnan(t), t).alias("t")).withColumn("b", F.floor(F.col("t") / (SPAN * interval)))
    # a time and, a little early, the time from which the next is accepted: how many times of the block are not before it
    both = F.expr(f"inline(array(struct(t AS at, 1 AS own, t), struct(t + {at} - (abs(t) + {at}) * 1e-15D AS at, 0 AS own, t)))")
    marked = x.groupBy("k", "b").agg(F.collect_set("t").alias("ts")).select("k", "b", F.explode_outer("ts").alias("t")).select("k", "b", both)
    falling = Window.partitionBy("k", "b").orderBy(F.desc("at"), F.desc("own")).rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("c", F.sum("own").over(falling).cast("int"))
    each = marked.groupBy("k", "b").agg(F.expr("sort_array(collect_list(struct(t, c)) FILTER (WHERE own = 0 AND t IS NOT NULL), false) AS x"))
    tables = each.select("k", "b", F.expr(_TABLE.format(interval=at, span=SPAN)).alias("y"))
    groups = _joined(tables, ["k", f"floor(b / {GROUP}) AS b"], at)
    whole = _joined(groups, ["k"], at).select("k", F.expr("get(y, 0) AS e"))
    return whole.select(F.col("k.key").alias(key), F.expr("coalesce(e.n, 0L) AS n"), F.expr("e.last AS last_t"))
