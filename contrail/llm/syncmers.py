"""Document fingerprints: closed syncmers.

A k-mer (k bytes of the UTF-8 text) is chosen if, of the s-mers inside it, the one with the smallest hash (of equals, the
first) is the first or the last. The choice depends on nothing but the k-mer itself, so the same passage gives the same anchors in any text, at any
place; of every k - s consecutive k-mers at least one is chosen. A fingerprint is the list of anchors (place and hash of
each chosen k-mer). Likeness is the Jaccard similarity of the sets of anchor hashes; ``in_place`` matches by place too.

Only built-in functions are used: byte substrings take constant time, so a text takes time in proportion to its length.

Defined cases: null counts as the empty text, which has no anchors; a text of fewer than k bytes is one anchor; two texts
without anchors have likeness 1, one without and one with have 0; repeated rows are alike; ids may repeat or be null
(:func:`with_next` orders ties by a hash of the text, nulls last); other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrail.llm.common import let


#: Bytes of an anchor, some four words, and of the substrings that choose it: an anchor for about 8.5 bytes of text.
K, S = 24, 8


def _smallest_from(x: Column, values: Column, others: list[Column]) -> Column:
    """True if x is no larger than the values at all the places ``others``. The nearest are compared first, and the
    nested AND stops at the first smaller one: some three comparisons for most places. Null beyond an end of the array."""
    return reduce(lambda rest, at: (x <= F.get(values, at)) & rest, reversed(others), F.lit(True))


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """Array of (place, hash) of the closed syncmers of a text; places are byte offsets from 0, in order.

    s-mers are ordered by 33 bits of their hash, equal ones by place: both stand in one number, so that a
    comparison settles ties and a minimum tells where it is.
    """
    w, bits = k - s + 1, 31

    def chosen(data: Column, inner: Column) -> Column:
        mask = F.lit((1 << bits) - 1)
        first = F.filter(inner, lambda x, i: _smallest_from(x, inner, [i + j for j in range(1, w)]))
        last = F.filter(inner, lambda x, i: _smallest_from(x, inner, [i - j for j in range(1, w)]))
        places = F.concat(F.transform(first, lambda x: x.bitwiseAND(mask)), F.transform(last, lambda x: x.bitwiseAND(mask) - (w - 1)))
        return F.transform(F.sort_array(places), lambda i: F.struct(i.cast("int").alias("place"), F.xxhash64(F.substr(data, (i + 1).cast("int"), F.lit(k))).alias("hash")))

    def of(data: Column) -> Column:
        inner = F.transform(F.sequence(F.lit(1), F.length(data) - (s - 1)), lambda i: F.xxhash64(F.substr(data, i, F.lit(s))).bitwiseAND(F.lit(-1 << bits)).bitwiseOR(i - 1))
        whole = F.array(F.struct(F.lit(0).alias("place"), F.xxhash64(data).alias("hash")))
        none = F.array().cast("array<struct<place:int,hash:bigint>>")
        return F.when(F.length(data) >= k, let(inner, lambda h: chosen(data, h))).when(F.length(data) > 0, whole).otherwise(none)

    return let(F.coalesce(text.cast("binary"), F.lit(b"")), of)


def fingerprint(text: Column, k: int = K, s: int = S) -> Column:
    """The anchors as two arrays, ``places`` and ``hashes``."""
    return let(anchors(text, k, s), lambda a: F.struct(a["place"].alias("places"), a["hash"].alias("hashes")))


def joined(own: Column, following: Column, left: Column, right: Column, k: int = K, s: int = S) -> Column:
    """The fingerprint of the text ``left || right``, where own is that of a text that begins with ``left`` and following
    that of one that begins with ``right``. Anchors are free of context: those within either part are known, and only the
    k-mers across the seam are examined."""

    def of(sides: Column) -> Column:
        a, b = sides["a"], sides["b"]
        n, m = F.length(a), F.length(b)
        start = F.greatest(F.lit(0), n - (k - 1))
        inside = lambda fp, size: F.size(F.filter(fp["places"], lambda p: p <= size - k))  # noqa: E731  how many anchors
        seam = F.concat(F.substr(a, start + 1, F.lit(k - 1)), F.substr(b, F.lit(1), F.lit(k - 1)))
        none = F.array().cast("array<struct<place:int,hash:bigint>>")
        parts = F.struct(F.when(F.length(seam) >= k, anchors(seam, k, s)).otherwise(none).alias("seam"), inside(own, n).alias("i"), inside(following, m).alias("j"))

        def put(x: Column) -> Column:
            places = F.concat(F.slice(own["places"], F.lit(1), x["i"]), F.transform(x["seam"], lambda c: c["place"] + start), F.transform(F.slice(following["places"], F.lit(1), x["j"]), lambda p: p + n))
            hashes = F.concat(F.slice(own["hashes"], F.lit(1), x["i"]), x["seam"]["hash"], F.slice(following["hashes"], F.lit(1), x["j"]))
            return F.struct(places.alias("places"), hashes.alias("hashes"))

        return F.when(n + m < k, fingerprint(F.concat(a, b), k, s)).otherwise(let(parts, put))

    return let(F.struct(F.encode(left, "utf-8").alias("a"), F.encode(right, "utf-8").alias("b")), of)


def encoded(fp: Column) -> Column:
    """A fingerprint as text: ``place:hash`` of each anchor in order, 32 bits of the hash in hexadecimal."""
    return F.array_join(F.zip_with(fp["places"], fp["hashes"], lambda p, h: F.concat(p.cast("string"), F.lit(":"), F.hex(h.bitwiseAND(F.lit(0xFFFFFFFF))))), " ")


def in_place(a: Column, b: Column, block: int = 512) -> Column:
    """The share of a's anchors that b has in the same or a neighbouring block of places; 1 if a has none."""

    def at(fp: Column, shift: int) -> Column:
        return F.zip_with(fp["places"], fp["hashes"], lambda p, h: F.xxhash64(h, F.floor(p / block) + shift))

    def share(keys: Column) -> Column:
        return F.when(F.size(keys) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(keys, F.concat(*[at(b, i) for i in (-1, 0, 1)]))) / F.size(keys))

    return let(F.array_distinct(at(a, 0)), share)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes."""
    common = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - common
    return F.when(every == 0, F.lit(1.0)).otherwise(common / every)


def digest(hashes: Column) -> Column:
    """A fingerprint as one short string: SHA-256 of the anchors' hashes in text order."""
    return F.sha2(F.concat_ws(",", F.transform(hashes, lambda h: F.hex(h))), 256)


def with_next(docs: DataFrame, own, id_col: str = "doc_id", text_col: str = "text", per_partition: int = 3) -> DataFrame:
    """``id, text, fp, next_text, next_fp``: each row with the row after it in the order of descending id (after the last
    comes the first), and ``own(text)`` of both.

    No task sees the whole order: quantiles of the ids cut it into ranges, a window runs in each range, and a range's last
    row gets the first row of the next range. An id that takes up several quantiles, and null, is cut into as many ranges
    by a hash of the text, which orders its rows. Texts are shuffled once.
    """
    spark = docs.sparkSession
    n = per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    every = rows.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 20 * n).alias("q"), F.count(F.lit(1)).alias("c"), F.count("id").alias("with_id")).first()
    found = Counter(every["q"] or [])
    cuts = F.array(*[F.lit(c) for c in sorted(found)]).cast("array<bigint>")
    hot = {v: c for v, c in found.items() if c > 1}
    if every["with_id"] < every["c"]:
        hot[None] = max(1, n * (every["c"] - every["with_id"]) // every["c"])
    place = F.when(F.col("id").isNull(), F.lit(n + 1)).otherwise(F.size(F.filter(cuts, lambda c: c > F.col("id"))))
    part = F.lit(0)
    for v, c in hot.items():  # of a place, rows with the id that cuts it come last; fewer than n values
        part = F.when(F.col("id").eqNullSafe(F.lit(v).cast("long")), c - F.floor((F.col("h") / 2.0**64 + 0.5) * c)).otherwise(part)
    rows = rows.withColumn("range", place * (2 * n) + part)

    # the first row of each range
    heads = rows.groupBy("range").agg(F.max(F.struct("id", "h")).alias("top")).select(F.col("range").alias("r"), F.col("top.id").alias("top_id"), F.col("top.h").alias("top_h"))
    first = rows.join(F.broadcast(heads), (F.col("range") == F.col("r")) & F.col("id").eqNullSafe(F.col("top_id")) & (F.col("h") == F.col("top_h")))
    first = first.groupBy("range").agg(F.max("text").alias("text"))
    order = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = first.select("range", F.coalesce(F.lead("text").over(Window.orderBy("range")), F.first("text").over(order)).alias("after_range"))

    x = rows.repartition("range").withColumn("fp", own(F.col("text")))
    w = Window.partitionBy("range").orderBy(F.col("id").desc_nulls_last(), F.col("h").desc(), F.col("text").desc())
    x = x.withColumn("lead", F.lead(F.struct("text", "fp")).over(w)).join(after.withColumnRenamed("range", "r"), (F.col("range") == F.col("r")) & F.col("lead").isNull(), "left")
    return x.select("id", "text", "fp", F.coalesce("lead.text", "after_range").alias("next_text"), F.when(F.col("lead").isNotNull(), F.col("lead.fp")).otherwise(own(F.col("after_range"))).alias("next_fp"))


def edited_parts(text: Column, following: Column) -> tuple[Column, Column]:
    """The kept first half of a text, and the first characters of the following text that replace its last half."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.substr(text, F.lit(1), F.length(text) - half), F.substr(following, F.lit(1), half)
