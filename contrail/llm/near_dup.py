"""MinHash near-duplicates of weighted shingles: ProbMinHash signatures, banding, exact verification, classes.

Shingles are runs of five words (lower case, split at Unicode white space), weighted by how often they occur; a text of one
to four words is one shingle. ProbMinHash runs a Poisson process for each shingle, with its weight as rate: arrivals fall
into random signature components, each component keeps its earliest arrival's element, and a shingle stops as soon as its
next arrival is later than the latest component. Two components agree with the probability Jaccard similarity

    J_P = sum over common d of 1 / sum over d' of max(v(d')/v(d), w(d')/w(d)),

which is the Jaccard similarity when all weights are equal. ``1 - J_P`` is a collision probability, hence a metric.

Texts, not ids, are compared: a text's key is the first half of its SHA-256, so rows that share an id or have none are
rows like all others. Steps, none of which emits all pairs of a group: (1) equal texts share a key and are one text from
then on. (2) Bands of the signatures are grouped; all members of a bucket are paired with its leaders, the few members that
share their buckets with most other texts. (3) Pairs whose signatures agree enough to be similar are verified on the whole texts by exact J_P. (4)
Linked texts get one class by repeated contraction. (5) Two texts in one class need no further test; members of a bucket
that are still in different classes are compared by sketches (one bit each of many more components) inside the join,
which emits only the pairs that agree enough, each in the first bucket that both are in; these are verified too. The
comparisons of a bucket are dealt out in blocks of its members, so no bucket is one task. They still grow with the square
of a bucket's members that are in different classes, as it takes a comparison to know that two of them are no copies.
Keys that many rows share (copies of one text, buckets, hubs of links) are joined between stored tables alone: Spark
then knows the sizes of both sides' partitions and splits one that is too large (adaptive skew joins).
Signatures of ``bands * band_rows`` components miss a pair at the threshold with probability (1 - t^r)^b: 5e-5 here.

Defined cases: a null text is like no other row, its class is its own id; empty texts are equal to each other; repeated
rows fall into one class; ids must be whole numbers; a class is named by the smallest id in it (null if none of its rows
has one) and by ``class_key``, which no two classes share even where ids do; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from contrail.llm.common import drop_stored, slices, stored

_MEMO = 250_000
_HELD = 2_000_000  # shingles of texts a task remembers while it verifies pairs
_BLOCK = 1024  # members of a bucket that one task compares with its others
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Hashes of a text's shingles and their counts; words' hashes are remembered for a bounded number of words."""

    def __init__(self, size: int = 5):
        self.size, self.memo = size, {}

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words, memo = text.lower().split(), self.memo
        if len(memo) > _MEMO:
            memo.clear()
        for w in words:
            if w not in memo:
                memo[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        if len(h) == 0:
            return h, np.zeros(0)
        n = min(self.size, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
        hashes, counts = np.unique(out, return_counts=True)
        return hashes, counts.astype(float)


def prob_minhash(hashes: np.ndarray, weights: np.ndarray, m: int) -> np.ndarray:
    """Signature of m components (32 bits of the winning element's hash). All elements advance together, a few arrivals
    at a time; those whose next arrival is later than every component's earliest are finished and leave."""
    best = np.full(m, np.inf)
    owner = np.full(m, hashes[0], np.uint64)
    if len(hashes) > 1:
        state, at = _mix(hashes + np.uint64(0x51)), np.zeros(len(hashes))
        rate, who = weights / weights.sum(), hashes
        while len(who):
            ahead = np.arange(1, max(1, 1000 // len(who)) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            draws = _mix(state[:, None] + ahead)
            times = at[:, None] + np.cumsum(-np.log(((draws >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)), axis=1) / rate[:, None]
            slot = (_mix(draws ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(m)).astype(np.int64)
            new = best.copy()
            np.minimum.at(new, slot.ravel(), times.ravel())
            row, col = np.nonzero((times == new[slot]) & (times < best[slot]))
            owner[slot[row, col]] = who[row]
            best = new
            on = times[:, -1] < best.max()
            state, at, rate, who = state[on] + ahead[-1], times[on, -1], rate[on], who[on]
    return (_mix(owner) >> np.uint64(32)).astype(np.uint32)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact J_P of two weighted sets; 0 if one is empty."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if len(common) == 0:
        return 0.0
    v, w = a[1] / a[1].sum(), b[1] / b[1].sum()
    every = np.union1d(a[0], b[0])
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a[0])], y[np.searchsorted(every, b[0])] = v, w
    r = v[i] / w[j]  # of a common element; sum of max(x/v, y/w) = (sum over x/y > r of x)/v + (the others' y)/w
    ratio = np.divide(x, y, out=np.full(len(every), np.inf), where=y > 0)
    order = np.argsort(ratio)
    ratio, below_y, above_x = ratio[order], np.append(0, np.cumsum(y[order])), np.append(np.cumsum(x[order][::-1])[::-1], 0)
    cut = np.searchsorted(ratio, r, side="right")
    return float((1.0 / (above_x[cut] / v[i] + below_y[cut] / w[j])).sum())


def signatures(docs: DataFrame, bands: int, band_rows: int, size: int) -> DataFrame:
    """``id, sig, keys``: the signature and a 64-bit key for each band. ``docs`` has ``id, text``, ids being text keys."""
    m = bands * band_rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles(size)
        for b in slices(batches):
            ids, sigs, keys = [], [], []
            for k, t in zip(b["id"], b["text"], strict=True):
                hashes, weights = shingles.of(t)
                if len(hashes):
                    sig = prob_minhash(hashes, weights, m)
                    key = np.arange(bands, dtype=np.uint64)
                    for c in sig.reshape(bands, band_rows).T:
                        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + c)
                    ids.append(k)
                    sigs.append(sig.view(np.int32))
                    keys.append(key.view(np.int64))
            if ids:
                yield pd.DataFrame({"id": ids, "sig": sigs, "keys": keys})

    return docs.mapInPandas(run, "id binary, sig array<int>, keys array<long>")


def _agreement(a: str, b: str) -> Column:
    """The share of equal components of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda total, x: total + x) / F.size(a)


def sketches(docs: DataFrame, words: int, size: int) -> DataFrame:
    """``id, bits``: one bit of each of ``64 * words`` signature components. ``docs`` has ``id, text``, texts not empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles(size)
        for b in slices(batches):
            bits = [np.packbits((prob_minhash(*shingles.of(t), 64 * words) & 1).astype(np.uint8)).view(np.int64) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "bits": bits})

    return docs.mapInPandas(run, "id binary, bits array<long>")


def _maybe_similar(a: str, b: str, words: int, threshold: float, deviations: float) -> Column:
    """True unless two sketches differ in more bits than texts of similarity ``threshold`` would: half of the components
    that disagree show in a bit, here with a margin of some standard deviations."""
    q = (1 - threshold) / 2
    most = 64 * words * q + deviations * (64 * words * q * (1 - q)) ** 0.5
    differ = [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(words)]
    return reduce(lambda x, y: x + y, differ) <= F.lit(int(most))


def _verified(pairs: DataFrame, docs: DataFrame, threshold: float, size: int) -> DataFrame:
    """``a, b, similarity`` of the pairs, a stored table, that are similar by their whole texts; each pair once, a < b."""
    a, b = docs.select(F.col("id").alias("a"), F.col("text").alias("ta")), docs.select(F.col("id").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, held, kept = Shingles(size), {}, 0
        for p in slices(batches):
            s = []
            for both in zip(p["ta"], p["tb"], strict=True):
                for t in both:
                    if t not in held:
                        if kept > _HELD:
                            held, kept = {x: held[x] for x in both if x in held}, 0
                        held[t] = shingles.of(t)
                        kept += len(held[t][0])
                s.append(probability_jaccard(held[both[0]], held[both[1]]))
            p["similarity"] = s
            yield p.loc[p["similarity"] >= threshold, ["a", "b", "similarity"]]

    same = pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInPandas(run, "a binary, b binary, similarity double")
    return same.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("similarity").alias("similarity"))


def connected(links: DataFrame) -> DataFrame:
    """``id, root`` for every id in ``links`` (a, b) that is connected to a smaller one: the smallest of them. A stored table.

    Contraction: each node goes to the smallest of itself and its neighbours, edges go along, and those that join a node
    to itself fall away, until none is left; then the steps are put together. Edges never grow in number, and with ids in
    no order along the links (text keys are hashes) each round leaves less than about half of the nodes. Each round's
    tables are in the shared folder, so a lost executor costs one round at most.
    """

    def kept(edges: DataFrame) -> tuple[DataFrame, int]:
        seen = Observation()
        out = stored(edges.where("u <> v").distinct().observe(seen, F.count(F.lit(1)).alias("n")))
        return out, seen.get["n"]

    edges, n = kept(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    steps = []
    while n or not steps:
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        steps.append(stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))))
        moved = edges.join(steps[-1].withColumnRenamed("m", "mu"), "u").join(steps[-1].select(F.col("u").alias("v"), F.col("m").alias("mv")), "v")
        new, n = kept(moved.select(F.greatest("mu", "mv").alias("u"), F.least("mu", "mv").alias("v")))
        drop_stored(edges)
        edges = new
    root = steps[0]
    for step in steps[1:]:
        root = root.join(step.select(F.col("u").alias("m"), F.col("m").alias("next")), "m", "left").select("u", F.coalesce("next", "m").alias("m"))
    out = stored(root.where("u <> m").select(F.col("u").alias("id"), F.col("m").alias("root")))
    for done in (edges, *steps):
        drop_stored(done)
    return out


def text_key(text: str | Column) -> Column:
    """A text's name: the first 16 bytes of its SHA-256; null for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.substring(F.unhex(F.sha2(c.cast("string"), 256)), 1, 16)


def text_classes(docs: DataFrame, text_col: str = "text", threshold: float = 0.8, size: int = 5, bands: int = 28, band_rows: int = 5, slack: float = 0.15, leaders: int = 2, sketch_words: int = 32, deviations: float = 4.2) -> DataFrame:
    """``key, root, n_links`` for each text that is linked to a different one: its key, the smallest key of its class, and
    the number of verified links (those that the classes needed). A stored table; texts linked to no other have no row.

    ``slack``: a pair with a leader is verified if its signatures agree in ``threshold - slack`` of the components, over
    four standard deviations below. ``leaders``: how many members of a bucket all its members are paired with at first.
    ``sketch_words, deviations``: size of the sketches that members in different classes are compared by, in words of 64
    bits, and the margin of that comparison (2048 bits and 4.2 deviations pass similarities from about 0.74 and miss a
    pair at the threshold with probability 1.3e-5).
    """
    rows = docs.select(text_key(text_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    signed = stored(signatures(rows, bands, band_rows, size).groupBy("id").agg(F.first("sig").alias("sig"), F.first("keys").alias("keys")))
    keys = signed.select("id", F.explode("keys").alias("key"))
    buckets = stored(keys.join(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key"))
    central = stored(buckets.groupBy("id").agg(F.sum("n").alias("company")))
    # one row for each text, whose copies within a task go before the shuffle; an inner join, as a semi join would be moved
    # below the aggregate at some sizes and not at others
    texts = stored(rows.groupBy("id").agg(F.first("text").alias("text")).join(central.select("id"), "id"))

    # leaders: of each of a few parts of a bucket the text that shares its buckets with most others, so that a group of
    # copies has few of them, its original first
    part = F.pmod(F.xxhash64("id"), F.lit(leaders))
    lead = stored(buckets.join(central, "id").groupBy("key", part.alias("part")).agg(F.max(F.struct("company", "id"))["id"].alias("leader")).select("key", "leader"))
    met = stored(buckets.join(lead, "key").where("leader <> id").select("leader", "id").distinct())
    sig_of = lambda name: signed.select(F.col("id").alias(name), F.col("sig").alias(f"{name}_sig"))
    alike = _agreement("leader_sig", "id_sig") >= threshold - slack
    led = stored(met.join(sig_of("leader"), "leader").join(sig_of("id"), "id").where(alike).select(F.col("leader").alias("a"), F.col("id").alias("b")))
    links = stored(_verified(led, texts, threshold, size))
    for done in (signed, central, met, led):
        drop_stored(done)
    classes = connected(links)

    # what is left: members that are no leaders and still in different classes, but for those within the largest class
    now = buckets.join(lead, (buckets["key"] == lead["key"]) & (buckets["id"] == lead["leader"]), "left_anti").join(classes, "id", "left")
    now = stored(now.select("key", "id", F.coalesce("root", "id").alias("root")))
    by_class = now.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    open_keys = stored(by_class.groupBy("key").agg(F.sum("c").alias("members"), F.count(F.lit(1)).alias("n"), F.max(F.struct("c", "root"))["root"].alias("main")).where("n > 1").select("key", "main", F.ceil(F.col("members") / _BLOCK).alias("parts")))
    rest = now.join(open_keys, "key")
    drawn = sketches(texts.join(rest.select("id").distinct(), "id", "left_semi"), sketch_words, size)
    every = rest.groupBy("id").agg(F.collect_set("key").alias("keys"))  # at most one key for each band
    rest = stored(rest.join(drawn.join(every, "id"), "id"))
    # the outsiders of a bucket in parts by a hash, each against all its members
    outside = rest.where("root <> main").select("key", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), F.col("id").alias("a"), F.col("root").alias("ra"), F.col("bits").alias("ba"), F.col("keys").alias("ka"))
    others = rest.select(F.col("key").alias("k"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("p"), F.col("id").alias("b"), F.col("root").alias("rb"), F.col("bits").alias("bb"), F.col("keys").alias("kb"), "main")
    once = (F.col("rb") == F.col("main")) | (F.col("a") < F.col("b"))  # a pair of two outsiders meets twice
    once = once & (F.array_min(F.array_intersect("ka", "kb")) == F.col("key"))  # the first bucket both are in
    same = (F.col("key") == F.col("k")) & (F.col("part") == F.col("p"))
    more = outside.repartition("key", "part").join(others.repartition("k", "p"), same & (F.col("ra") != F.col("rb")) & _maybe_similar("ba", "bb", sketch_words, threshold, deviations) & once)
    more = stored(more.select("a", "b"))
    found = stored(_verified(more, texts, threshold, size))
    if not found.isEmpty():
        drop_stored(classes)
        classes = connected(links.union(found))
    degree = links.union(found).select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    out = stored(degree.join(classes, "id", "left").select(F.col("id").alias("key"), F.coalesce("root", "id").alias("root"), "n_links"))
    for done in (buckets, texts, lead, links, classes, now, open_keys, rest, more, found):
        drop_stored(done)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``id_col, class_id, class_key, n_links``: one row for each row of ``docs``.

    ``class_id`` is the smallest id among the rows whose texts are connected by links of similarity ``threshold`` or more
    (or equal), ``class_key`` the class's own name in hexadecimal (null for a null text), ``n_links`` how many verified
    links to different texts this row's text has. ``options``: see :func:`text_classes`.
    """
    rows = stored(docs.select(F.col(id_col).cast("long").alias("id"), text_key(text_col).alias("key")))
    linked = text_classes(docs, text_col, **options)
    texts = rows.where("key is not null").groupBy("key").agg(F.min("id").alias("least")).join(linked, "key", "left")
    texts = stored(texts.select("key", "least", F.coalesce("root", "key").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    ids = stored(texts.groupBy("root").agg(F.min("least").alias("class_id")))
    named = stored(texts.join(ids, "root").select("key", "root", "class_id", "n_links"))
    for done in (linked, texts, ids):
        drop_stored(done)
    out = rows.join(named, "key", "left")
    own = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("class_id"))
    return out.select(F.col("id").alias(id_col), own.alias("class_id"), F.hex("root").alias("class_key"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
