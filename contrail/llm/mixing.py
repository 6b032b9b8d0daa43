"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Sources share the total of all sizes by weight. A source's target stops at ``max_epochs`` times its size; what it leaves
is reshared by weight among the others until no target is above its cap. With sources in the order of cap / weight the
capped ones are a prefix, so the common level is found with running sums over the table of sources (one row for each
source) and no loop.

A source at target / size = e is taken floor(e) whole times; the fractional repetition takes, in the order of a seeded
hash of the id, the documents whose middle falls within the remaining words, so a source ends within half a document of
its target. The order's running sum is split: a large source is cut by hash into parts of about ``rows_per_part`` rows
that are summed apart, and the parts' totals are summed after that; no source meets in one task.

Texts are read once for their sizes; all else works on a stored table of ids, sources and sizes. Where columns of the
documents are asked for (``keep``), the documents taken once more are a prefix of their source's order, so each source's
last one decides: a row for each source is joined to the documents, which are not shuffled.

Defined cases: a null or empty text has size 0; a null source is a source, last in order; a source of size 0 has target
0; ties of the hash are broken by the id, then by a hash of the text; rows without id are ordered by that hash; repeated
rows are separate documents, but with ``keep`` rows alike in source, id and text are taken alike; an empty table gives no
rows. Only built-in DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrail.llm.common import WORD, drop_stored, stored


def words(text: str | Column) -> Column:
    """Number of words of a text; 0 for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD + "+")), F.lit(0)).cast("long")


def order_of(id_col: Column, seed: int) -> Column:
    """A whole number below 2^32 from the seed and the id as text."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: float = 3) -> DataFrame:
    """``source, source_size, n, target`` of ``source, source_size, n``: weights repeat over sources by code point, null last."""
    # string order in Spark is by UTF-8 bytes, which is the order of code points
    by_name, by_fill = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("fill", "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    every = Window.partitionBy()
    s = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(max_epochs))
    s = s.withColumn("fill", F.col("cap") / F.col("weight")).withColumn("total", F.sum("source_size").over(every).cast("double"))
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", left / open_weight)  # if this source and all after it are open
    s = s.withColumn("at", F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "rank", "level"))).over(every))
    target = F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("at.level")))
    return s.select("source", "source_size", "n", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), max_epochs: float = 3, seed: int = 7, rows_per_part: int = 2000, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col, size, source, source_size, target, repetitions, taken`` and the columns ``keep`` for each row of ``docs``.

    ``repetitions`` is how often the mix takes the document, ``taken`` its words in the mix.
    """
    tie = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    order = order_of(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null "), tie.cast("string"))), seed)
    base = [F.col(id_col).alias("__id"), F.col(source_col).alias("source"), order.alias("order"), tie.alias("tie"), words(text_col).alias("size")]
    rows = stored(docs.select(*base))
    sizes = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), weights, max_epochs)
    sizes = sizes.select(F.col("source").alias("__source"), "source_size", "n", "target")
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    x = rows.join(sizes, F.col("source").eqNullSafe(F.col("__source")))
    x = x.withColumn("whole", F.floor(epochs)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / rows_per_part))
    x = x.withColumn("part", F.floor(F.col("order") * parts / F.lit(float(1 << 32))).cast("long"))
    totals = x.groupBy("__source", "part").agg(F.sum("size").alias("part_size"))
    ahead = Window.partitionBy("__source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("__source").alias("__s"), F.col("part").alias("__p"), F.coalesce(F.sum("part_size").over(ahead), F.lit(0)).alias("before_part"))
    x = x.join(totals, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("part") == F.col("__p")))
    inside = Window.partitionBy("__source", "part").orderBy("order", F.col("__id").asc_nulls_last(), "tie").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before_part") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    x = x.withColumn("more", (start + F.col("size") / 2.0 <= F.col("rest")) & (F.col("whole") < max_epochs))
    place = F.struct("order", F.col("__id").isNull().alias("none"), "__id", "tie")
    if keep:
        last = x.where("more").groupBy("__source").agg(F.max(place).alias("last"))
        each = sizes.join(last.withColumnRenamed("__source", "__s"), F.col("__source").eqNullSafe(F.col("__s")), "left")
        each = stored(each.select("__source", "source_size", "target", F.floor(epochs).alias("whole"), "last"))
        drop_stored(rows)
        x = docs.select(*base, *[F.col(c).alias(f"__keep_{c}") for c in keep]).join(each, F.col("source").eqNullSafe(F.col("__source")))
        x = x.withColumn("more", F.coalesce(place <= F.col("last"), F.lit(False)))
    x = x.withColumn("repetitions", (F.col("whole") + F.col("more").cast("long")).cast("long"))
    return x.select(F.col("__id").alias(id_col), "size", "source", "source_size", "target", "repetitions", (F.col("repetitions") * F.col("size")).alias("taken"), *[F.col(f"__keep_{c}").alias(c) for c in keep if c not in (id_col, source_col)])
