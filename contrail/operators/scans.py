"""Segmented prefix scans: running values of each key's rows in order, without a key being one task.

A key's rows are cut into blocks by a whole number that never decreases in their order. Blocks are scanned apart, by a window
over (key, block). What a block hands to those after it, its carry, is one row: the last value that is not null, or a sum.
Carries of a key are scanned, in blocks of blocks if they are very many, and joined to the rows of their block. So the largest
group of rows that one task sorts is a block, or a key's carries.

A null key is a key like any other; keys are compared as one struct, which is never null, so that the join and the window
share one partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block by default, and blocks of a block of blocks.
BLOCK = 4096


@dataclass(frozen=True)
class Running:
    """A running value: ``last`` (non-null so far), ``sum`` or ``max`` of ``value``, up to a row or, if not ``inclusive``,
    before it. A sum is 0 and the others are null where there is nothing yet."""

    kind: str
    value: Column
    inclusive: bool = True

    def carry(self, order: Column) -> Column:
        """Of a block's rows."""
        if self.kind == "last":
            return F.max_by(self.value, F.when(self.value.isNotNull(), order))
        return F.sum(self.value) if self.kind == "sum" else F.max(self.value)

    def over(self, value: Column, window, inclusive: bool) -> Column:
        w = window.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        if self.kind == "last":
            return F.last(value, True).over(w)
        return F.sum(value).over(w) if self.kind == "sum" else F.max(value).over(w)

    def joined(self, before: Column, here: Column) -> Column:
        """Of what came before a block and what is in it so far."""
        if self.kind == "last":
            return F.coalesce(here, before)
        if self.kind == "sum":
            return F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0))
        return F.greatest(before, here)


def blocks_of(order: str | Column, size: float = BLOCK) -> Column:
    """Blocks of a number: of ``size`` rows at most if it is whole and a key has each value once, of a span if it is a time."""
    return F.floor((F.col(order) if isinstance(order, str) else order) / F.lit(size)).cast("long")


def _before(carries: DataFrame, values: dict[str, Running], level: int) -> DataFrame:
    """``__k, __b`` and of each value what came before that block, from the blocks' own carries."""
    if level == 0:
        w = Window.partitionBy("__k").orderBy("__b")
        return carries.select("__k", "__b", *[r.over(F.col(n), w, False).alias(n) for n, r in values.items()])
    x = carries.withColumn("__s", F.floor(F.col("__b") / BLOCK))
    w = Window.partitionBy("__k", "__s").orderBy("__b")
    supers = x.groupBy("__k", "__s").agg(*[r.carry(F.col("__b")).alias(n) for n, r in ((n, Running(r.kind, F.col(n))) for n, r in values.items())])
    ahead = _before(supers.withColumnRenamed("__s", "__b"), values, level - 1).select(F.col("__k").alias("__sk"), F.col("__b").alias("__sb"), *[F.col(n).alias(f"__before_{n}") for n in values])
    inside = x.select("__k", "__b", "__s", *[r.over(F.col(n), w, False).alias(n) for n, r in values.items()])
    met = inside.join(ahead, (F.col("__k") == F.col("__sk")) & (F.col("__s") == F.col("__sb")), "left")
    return met.select("__k", "__b", *[r.joined(F.col(f"__before_{n}"), F.col(n)).alias(n) for n, r in values.items()])


def scan(rows: DataFrame, keys: list[str], order: list[str], block: Column, levels: int = 0, **values: Running) -> DataFrame:
    """``rows`` with a column for each running value, by ``keys`` in the order of ``order`` (which should have no ties).

    ``block``: a whole number for each row that never decreases in that order (see ``blocks_of``). ``levels``: how often
    carries are put into blocks themselves. With none one task sorts a key's carries, one small row for each block; with
    one it sorts a row for 4096 blocks, for keys of more than some 10^11 rows.
    """
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    x = rows.select("*", key.alias("__k"), F.coalesce(block, F.lit(-(1 << 62))).alias("__b"))  # nulls come first
    asked = F.struct(*[F.col(c) for c in order]) if len(order) > 1 else F.col(order[0])
    carries = x.groupBy("__k", "__b").agg(*[r.carry(asked).alias(n) for n, r in values.items()])
    ahead = _before(carries, values, levels).select(F.col("__k").alias("__ck"), F.col("__b").alias("__cb"), *[F.col(n).alias(f"__before_{n}") for n in values])
    met = x.join(ahead, (F.col("__k") == F.col("__ck")) & (F.col("__b") == F.col("__cb")), "left")
    w = Window.partitionBy("__k", "__b").orderBy(*order)
    return met.select(*[F.col(c) for c in rows.columns], *[r.joined(F.col(f"__before_{n}"), r.over(r.value, w, r.inclusive)).alias(n) for n, r in values.items()])


def carried_forward(rows: DataFrame, keys: list[str], order: list[str], value: Column, out: str, block: Column) -> DataFrame:
    """Adds ``out``: the last value that is not null, up to each row."""
    return scan(rows, keys, order, block, **{out: Running("last", value)})


def numbered(rows: DataFrame, keys: list[str], order: list[str], block: Column, out: str = "idx", levels: int = 0) -> DataFrame:
    """Adds ``out``: the 1-based number of each row of its key."""
    return scan(rows, keys, order, block, levels, **{out: Running("sum", F.lit(1).cast("long"))})


def closed_frames(rows: DataFrame, keys: list[str], order: list[str], mark: Column, block: Column) -> DataFrame:
    """``keys, frame_no, n``: rows of each frame that a later mark closes, numbered from 0 by the marks before it; frames
    without rows and what follows a key's last mark are left out."""
    x = scan(rows.withColumn("__mark", mark.cast("long")), keys, order, block, frame_no=Running("sum", F.col("__mark")))
    frames = x.groupBy(*keys, "frame_no").agg(F.count_if(F.col("__mark") == 0).alias("n"))
    # the mark that closes a frame opens the next one
    named = x.where("__mark = 1").select(F.struct(*keys).alias("__fk"), (F.col("frame_no") - 1).alias("__f"))
    met = frames.where("n > 0").withColumn("__fs", F.struct(*keys)).join(named, (F.col("__fs") == F.col("__fk")) & (F.col("frame_no") == F.col("__f")), "left_semi")
    return met.select(*keys, "frame_no", "n")
