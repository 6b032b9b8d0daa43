"""LM scoring: stupid-backoff scores over bigrams of words, computed relationally.

Each word is scored by its bigram with the word before it (a start mark before the first),

    S(w | v) = count(v w) / count(v *)   if count(v w) > 0,   else 0.4 count(w) / count(*),

and a text's log score is the sum over its words. All n-grams count, seen once or more; a word that the counted texts do
not hold at all counts as seen once. Words are runs without (Unicode) white space, in lower case.

:func:`score_against` scores texts under the counts of other texts, :func:`score_left_out` each text of a table under the
counts of all the others: all are counted, and what a text itself adds is taken off where it is scored, so what only it
says backs off. Both explode the texts into a row for each distinct bigram and join these rows to the table of counts by
buckets of bigrams (a hash of the bigram), look up the count of the context (held bigrams) or of the word (others), and sum
for each text. Spark shuffles the rows once, packed in lists by bucket; where texts are scored under the counts of the same
table, these lists are what the table of counts is summed from. A bucket holds about a million words, however many there
are, and is joined at a time. Two bounded tables keep rows, and every hot key, out of the shuffles without changing a result:

* ``common``: the exact counts of so many words at most, the most frequent ones, are broadcast (32 bytes each); others
  are looked up in a second join, which only rows in need of one go through;
* ``dense``: exact counts of all pairs of so many most frequent words, a square matrix, are broadcast too. A pair is no
  more frequent than its words, so of the pairs that are left none has more than its share in ``dense`` of all words.

A pair of two common words is named by their two ranks, which is exact; other n-grams are named by a 63-bit hash.

Defined cases: null and empty texts have no words, log score 0 and a null mean; equal texts have equal scores; each input
row gives one row, rows that repeat an id or have none too (a text left out is one row, so its copies still count; rows
are told apart by ``monotonically_increasing_id``); very long texts and words are scored whole; other columns are ignored; an empty table gives no rows, and under the counts of
none every word counts as seen once among one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.llm.common import slices, stored

DISCOUNT = 0.4
_MEMO = 250_000
_ROWS = 200_000  # rows of exploded texts in a batch
_BLOCK = 1_000_000  # exploded rows that are put into lists together
_BUCKETS, _BUCKET_WORDS = 64, 1_000_000  # buckets of bigrams at least, and words to a bucket
_RANK = np.int64(20)  # bits of a common word's rank
_P, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _named(x: np.ndarray) -> np.ndarray:
    """63 bits of a hash below zero, where no pair of ranks is."""
    return (_mix(x) | np.uint64(1 << 63)).view(np.int64)


def _pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _named(v * _P + w)


class _Slots(dict):
    """Numbers words in the order they are first met."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Words:
    """Texts as arrays of word slots; slot 0 is the start mark, hashed as the empty word that no text has. Words are
    remembered up to a bound."""

    def __init__(self):
        self.slots, self.h = _Slots({None: 0}), np.array([xxhash.xxh3_64_intdigest("")], np.uint64)

    def full(self) -> bool:
        return len(self.slots) > _MEMO

    def read(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text its slots behind the start mark; ``h`` then holds the hashes of all slots."""
        get = self.slots.__getitem__
        said = [t.lower().split() if t else [] for t in texts]
        out = [np.fromiter(map(get, w), np.int64, len(w)) for w in said]
        if len(self.slots) > len(self.h):
            new = list(self.slots)[len(self.h) :]
            self.h = np.append(self.h, np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new)))
        return [np.append(0, x) for x in out]


def _text_column(docs: DataFrame, text_col: str) -> Column:
    return F.col(text_col).cast("string").alias("t")


def _chunks(said: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Neighbouring texts together, as soon as they have so many words; and the place of the first."""
    at, size = 0, 0
    for i, x in enumerate(said):
        size += len(x)
        if size > _ROWS or i == len(said) - 1:
            yield at, said[at : i + 1]
            at, size = i + 1, 0


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``h, c, f``: the hash of each word (and of the start mark), how often a word follows it, and how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = Words(), np.zeros((2, 0), np.int64)

        def flush() -> pa.RecordBatch:
            hit = np.flatnonzero(seen.any(axis=0))
            return pa.RecordBatch.from_arrays([pa.array(words.h[hit].view(np.int64)), pa.array(seen[0][hit]), pa.array(seen[1][hit])], ["h", "c", "f"])

        for b in slices(batches):
            if words.full():
                yield flush()
                words, seen = Words(), np.zeros((2, 0), np.int64)
            for _, said in _chunks(words.read(b.column(0).to_pylist())):
                now = np.stack([np.bincount(np.concatenate([x[part] for x in said]), minlength=len(words.h)) for part in (slice(None, -1), slice(1, None))])
                now[:, : seen.shape[1]] += seen
                seen = now
        yield flush()

    return docs.select(_text_column(docs, text_col)).mapInArrow(run, "h long, c long, f long").groupBy("h").agg(F.sum("c").alias("c"), F.sum("f").alias("f"))


def common_words(counts: DataFrame, bound: int) -> Ranks:
    """The most frequent words, at most ``bound``: all from some count on."""
    none = Ranks(*np.zeros((3, 0), np.int64))
    level = F.floor(F.log2(F.col("c") + F.col("f")) * 16)  # some hundred levels at most
    sizes = sorted(((r["level"], r["n"]) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, total = None, 0
    for at, n in sizes:
        total += n
        if total > bound:
            break
        least = at
    if least is None:
        return none
    got = counts.where(level >= least).toArrow()
    return Ranks(*(got[x].to_numpy() for x in ("h", "c", "f")))


class Ranks:
    """Common words: rank by count (of equals, by hash), hash, count as a context and as a word."""

    def __init__(self, h: np.ndarray, c: np.ndarray, f: np.ndarray):
        order = np.lexsort((h, -(c + f)))
        self.c, self.f = c[order], f[order]
        self.by_hash = np.argsort(h[order])
        self.h = h[order][self.by_hash]

    def __len__(self) -> int:
        return len(self.h)

    def of(self, h: np.ndarray) -> np.ndarray:
        """Rank of words by their hashes, -1 without one."""
        if not len(self):
            return np.full(len(h), -1)
        h = h.view(np.int64)
        at = np.minimum(np.searchsorted(self.h, h), len(self) - 1)
        return np.where(self.h[at] == h, self.by_hash[at], -1)


class Ranked(Words):
    """Word slots with the ranks of common words."""

    def __init__(self, ranks: Ranks):
        super().__init__()
        self.ranks, self.rank = ranks, ranks.of(self.h)

    def read(self, texts: list[str | None]) -> list[np.ndarray]:
        out, known = super().read(texts), len(self.rank)
        if len(self.h) > known:
            self.rank = np.append(self.rank, self.ranks.of(self.h[known:]))
        return out

    def pairs(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Keys of bigrams: two ranks, or a hash below zero."""
        a, b = self.rank[v], self.rank[w]
        return np.where((a >= 0) & (b >= 0), (a << _RANK) | b, _pair_key(self.h[v], self.h[w]))


def dense_pairs(docs: DataFrame, shared, dense: int, text_col: str = "text") -> np.ndarray:
    """How often each pair of the ``dense`` most frequent words occurs, as a matrix written row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = Ranked(shared.value), np.zeros(dense * dense, np.int64)
        for b in slices(batches):
            if words.full():
                words = Ranked(shared.value)
            for _, said in _chunks(words.read(b.column(0).to_pylist())):
                v, w = (words.rank[np.concatenate([x[part] for x in said])] for part in (slice(None, -1), slice(1, None)))
                both = (v >= 0) & (v < dense) & (w >= 0) & (w < dense)
                counts += np.bincount((v * dense + w)[both], minlength=dense * dense)
        hit = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(counts[hit])], ["pair", "c"])

    got = docs.select(_text_column(docs, text_col)).mapInArrow(run, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(dense * dense, np.int64)
    out[got["pair"].to_numpy()] = got["c"].to_numpy()
    return out


def pair_counts(docs: DataFrame, shared, dense: int, text_col: str = "text") -> DataFrame:
    """``k, f``: how often each bigram occurs that is not one of the dense ones, by its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, parts, size = Ranked(shared.value), [], 0

        def flush() -> pa.RecordBatch:
            k, n = np.unique(np.concatenate([np.zeros(0, np.int64), *parts]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["k", "n"])

        for b in slices(batches):
            if words.full():
                words = Ranked(shared.value)
            for _, said in _chunks(words.read(b.column(0).to_pylist())):
                v, w = (np.concatenate([x[part] for x in said]) for part in (slice(None, -1), slice(1, None)))
                a, c = words.rank[v], words.rank[w]
                rest = (a < 0) | (a >= dense) | (c < 0) | (c >= dense)
                parts.append(words.pairs(v[rest], w[rest]))
                size += len(parts[-1])
                if size > 4 * _ROWS:
                    yield flush()
                    parts, size = [], 0
        yield flush()

    return docs.select(_text_column(docs, text_col)).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("f"))


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each distinct key and how often it is among the keys, beside each key."""
    _, at, n = np.unique(keys, return_inverse=True, return_counts=True)
    return at, n[at]


def _pack(columns: list[np.ndarray]) -> bytes:
    """Whole numbers column by column, their bytes of like weight together, compressed."""
    planes = [x.view(np.uint8)[i :: x.itemsize] for x in map(np.ascontiguousarray, columns) for i in range(x.itemsize)]
    return pa.compress(pa.py_buffer(np.concatenate(planes)), codec="zstd", asbytes=True)


def _unpack(data: bytes, kinds: list, n: int) -> list[np.ndarray]:
    x, out, at = np.frombuffer(pa.decompress(data, n * sum(np.dtype(k).itemsize for k in kinds), codec="zstd"), np.uint8), [], 0
    for kind in kinds:
        out.append(np.empty(n, kind))
        size = out[-1].itemsize
        for i in range(size):
            out[-1].view(np.uint8)[i::size] = x[at : at + n]
            at += n
    return out


_LISTS = "bucket int, size int, rare int, base long, data binary, names binary, asked boolean, counted boolean, t long, part double, backed long, words long"
_DATA, _NAMES = [np.int64, *[np.int32] * 4], [np.int32, np.int32, np.int64, np.int64]


def _lists(k: np.ndarray, data: np.ndarray, names: list[np.ndarray], base: int, buckets: int, asked: bool, counted: bool) -> dict[str, list]:
    """Exploded rows as a list for each bucket of bigrams, in the order of their keys: first those named by a hash, below zero."""
    order = np.argsort(k)
    rare = order[k[order] < 0]
    bucket = (_mix(k.view(np.uint64)) % np.uint64(buckets)).astype(np.min_scalar_type(buckets))
    place = np.zeros(len(k), np.int64)
    place[np.flatnonzero(k < 0)] = np.arange(len(rare))
    order = order[np.argsort(bucket[order], kind="stable")]
    k, data, bucket = k[order], data[:, order], bucket[order]
    names = [x[place[order[k < 0]]] for x in names]
    out: dict[str, list] = {c.split()[0]: [] for c in _LISTS.split(", ")}
    ends, at = np.append(np.flatnonzero(np.diff(bucket)) + 1, len(k)), 0
    for i, j in zip(np.append(0, ends[:-1]), ends, strict=True):
        n = int(np.searchsorted(k[i:j], 0))
        row = (bucket[i], j - i, n, base, _pack([np.diff(k[i:j], prepend=0), *data[:, i:j]]), _pack([x[at : at + n] for x in names]), asked, counted, None, None, None, None)
        at += n
        for column, value in zip(out.values(), row, strict=True):
            column.append(value)
    return out


def _exploded(batches: Iterator[pa.RecordBatch], shared, left_out: bool, buckets: int, asked: bool, counted: bool) -> Iterator[pa.RecordBatch]:
    """A row for each distinct bigram of a text: the text's number ``t``, the bigram's key ``k``, how often the text has it, its
    context and its word (``n, m, o``) and, unless both words are common, the ranks of the two (``a, b``) and the hashes
    (``v, w``) of those without one; they leave as lists, one for each bucket of bigrams. And one row for the text
    (without a list): its id, what its dense pairs add, how many words among these back off, and its number of words."""
    ranks, dense, dense_f = shared.value
    words, parts, size, first_number, kind = Ranked(ranks), [], 0, 0, None
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    schema = [pa.field(name, types[kind]) for name, kind in map(str.split, _LISTS.split(", "))]

    def table(columns: dict[str, list], ids: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(v, f.type) for v, f in zip(columns.values(), schema, strict=True)), ids], [*columns, "id"])

    def flush() -> Iterator[pa.RecordBatch]:
        k, data, *names = (np.concatenate(x, axis=-1) for x in zip(*parts, strict=True))
        out = _lists(k, data, names, first_number, buckets, asked, counted)
        for i in range(0, len(out["bucket"]), 64):
            some = {k: v[i : i + 64] for k, v in out.items()}
            yield table(some, pa.nulls(len(some["bucket"]), kind))

    for batch in slices(batches):
        if words.full():
            words = Ranked(ranks)
        number, kind = batch.column(1).to_numpy(), batch.column(0).type
        for at, said in _chunks(words.read(batch.column(2).to_pylist())):
            n_words = np.fromiter((len(x) - 1 for x in said), np.int64, len(said))
            t = np.repeat(np.arange(len(said)), n_words)
            v, w = (np.concatenate([x[part] for x in said]) for part in (slice(None, -1), slice(1, None)))
            slots = len(words.h)
            (of_v, m), (_, o) = _counted(t * slots + v), _counted(t * slots + w)
            _, first, n = np.unique(of_v * slots + w, return_index=True, return_counts=True)
            m, o = m[first] * left_out, o[first] * left_out
            t, v, w = t[first], v[first], w[first]
            a, b = words.rank[v], words.rank[w]
            d = (a >= 0) & (a < dense) & (b >= 0) & (b < dense)
            f = dense_f[(a * dense + b)[d]] - (n[d] if left_out else 0)
            held = f > 0
            part = n[d] * np.log(np.where(held, f / np.maximum(ranks.c[a[d]] - m[d], 1), np.maximum(ranks.f[b[d]] - o[d], 1)))
            base, backed = (np.bincount(t[d], weights=x, minlength=len(said)) for x in (part, n[d] * ~held))
            numbers = number[at : at + len(said)]
            if asked:
                none, bucket = [None] * len(said), (_mix(numbers.view(np.uint64)) % np.uint64(buckets)).view(np.int64)
                own = (bucket, none, none, none, none, none, [asked] * len(said), [counted] * len(said), numbers, base, backed.astype(np.int64), n_words)
                yield table(dict(zip([f.name for f in schema], own, strict=True)), batch.column(0).slice(at, len(said)))
            t, v, w, a, b, n, m, o = (x[~d] for x in (t, v, w, a, b, n, m, o))
            if not len(t):
                continue
            k = words.pairs(v, w)
            if not parts:
                first_number = int(numbers[0])
            u = k < 0
            hv, hw = (np.where(rank[u] >= 0, 0, words.h[x[u]].view(np.int64)) for x, rank in ((v, a), (w, b)))
            parts.append((k, np.stack([n, m, o, numbers[t] - first_number]).astype(np.int32), a[u].astype(np.int32), b[u].astype(np.int32), hv, hw))
            size += len(t)
            if size > _BLOCK or numbers[-1] - first_number > 1 << 30:
                yield from flush()
                parts, size = [], 0
    if parts:
        yield from flush()


def _joined(bucket: pa.Table, shared, left_out: bool) -> pa.Table:
    """The exploded rows of a bucket of bigrams joined to the table of their counts, and to the counts of the common words.

    ``t, id, part, backed, words`` for each text; and for each row whose context (held bigrams) or word (others) is not
    common, its hash ``h``, ``as_context``, how often the text has it (``less``) and how often it counts (``sign``)."""
    ranks, _, _ = shared.value
    lists = bucket.filter(pc.is_valid(bucket["data"])).select(["size", "rare", "base", "data", "names", "asked", "counted"]).to_pylist()
    texts = bucket.filter(pc.is_null(bucket["data"])).select(["t", "id", "part", "backed", "words"])
    rows, names = [[np.zeros(0, x) for x in (*_DATA[:4], np.int64, bool, bool)]], [[np.zeros(0, x) for x in _NAMES]]
    for x in lists:
        k, n, m, o, t = _unpack(x["data"], _DATA, x["size"])
        rows.append([np.cumsum(k), n, m, o, t + np.int64(x["base"]), np.full(len(k), x["asked"]), np.full(len(k), x["counted"])])
        names.append(_unpack(x["names"], _NAMES, x["rare"]))
    k, n, m, o, t, asked, counted = map(np.concatenate, zip(*rows, strict=True))
    ra, rb, v, w = map(np.concatenate, zip(*names, strict=True))
    del lists, rows, names
    rare = k < 0
    a, b = (k >> _RANK).astype(np.int32), (k & ((1 << _RANK) - 1)).astype(np.int32)
    a[rare], b[rare] = ra, rb

    pairs, at = np.unique(k, return_inverse=True)
    f = np.bincount(at, weights=n * counted, minlength=len(pairs)).astype(np.int64)[at] - n * left_out
    held = f > 0
    rank, less, sign = np.where(held, a, b), np.where(held, m, o), np.where(held, -n, n)
    known = rank >= 0
    lower = np.ones(len(k), np.int64)
    for of, counts in ((held & known, ranks.c), (~held & known, ranks.f)):
        lower[of] = counts[rank[of]] - less[of]
    part = n * held * np.log(np.maximum(f, 1)) + sign * np.log(np.maximum(lower, 1))
    number, at = np.unique(t[asked], return_inverse=True)
    part, backed = (np.bincount(at, weights=x[asked], minlength=len(number)) for x in (part, n * ~held))
    need = asked & ~known  # only rows named by a hash
    named = need[rare]
    none = len(number) + len(texts)
    each = {"t": (number, t[need]), "part": (part.astype(float), np.zeros(need.sum())), "backed": (backed.astype(np.int64), np.zeros(need.sum(), np.int64))}
    out = {c: pa.concat_arrays([*texts[c].chunks, *map(pa.array, x)]) for c, x in each.items()}
    out["id"], out["words"] = (pa.concat_arrays([*texts[c].chunks, pa.nulls(len(number) + need.sum(), texts[c].type)]) for c in ("id", "words"))
    for c, x in (("h", np.where(held[need], v[named], w[named])), ("as_context", held[need]), ("less", less[need].astype(np.int64)), ("sign", sign[need].astype(np.int64))):
        x = pa.array(x)
        out[c] = pa.concat_arrays([pa.nulls(none, x.type), x])
    return pa.table({c: out[c] for c in ("t", "id", "part", "backed", "words", "h", "as_context", "less", "sign")})


def _score(docs: DataFrame, corpus: DataFrame, left_out: bool, id_col: str, text_col: str, common: int, dense: int, discount: float) -> DataFrame:
    if common >= 1 << int(_RANK):
        raise ValueError("common is below 2^20")
    spark = docs.sparkSession
    counts = stored(word_counts(corpus, text_col))
    total = counts.agg(F.sum("f")).first()[0] or 0
    ranks = common_words(counts, common)
    dense = min(dense, len(ranks))
    dense_f = dense_pairs(corpus, spark.sparkContext.broadcast(ranks), dense, text_col) if dense else np.zeros(0, np.int64)
    shared, kind = spark.sparkContext.broadcast((ranks, dense, dense_f)), docs.schema[id_col].dataType.simpleString()

    def lists(of: DataFrame, asked: bool, counted: bool, buckets: int) -> DataFrame:
        rows = of.select(F.col(id_col).alias("id") if asked else F.lit(None).cast(kind).alias("id"), F.monotonically_increasing_id().alias("number"), _text_column(of, text_col))
        return rows.mapInArrow(partial(_exploded, shared=shared, left_out=left_out, buckets=buckets, asked=asked, counted=counted), f"{_LISTS}, id {kind}")

    # bigrams are joined to their counts; held ones need the count of their context next, others that of their word
    buckets = max(_BUCKETS, total // _BUCKET_WORDS)
    x = lists(docs, True, left_out, buckets)
    if not left_out:
        x = x.unionByName(lists(corpus, False, True, buckets))
    x = x.groupBy("bucket").applyInArrow(lambda t: _joined(t, shared, left_out), f"t long, id {kind}, part double, backed long, words long, h long, as_context boolean, less long, sign long")
    sums = [F.sum(c).alias(c) for c in ("part", "backed", "words", "sign")]
    x = x.groupBy("t", "id", "h", "as_context").agg(*sums, F.max("less").alias("less"))

    # words that are not common: only what needs their counts is joined
    x = stored(x)
    rare = F.col("h").isNotNull()
    lower = lambda c: F.log(F.greatest(c, F.lit(1)))
    y = x.where(rare).join(counts, "h", "left")
    c = F.coalesce(F.when(F.col("as_context"), F.col("c")).otherwise(F.col("f")), F.lit(0))
    y = y.withColumn("part", F.col("part") + F.col("sign") * lower(c - F.col("less")))
    columns = ["t", "id", "part", "backed", "words"]
    x = x.where(~rare).select(columns).unionByName(y.select(columns))

    x = x.groupBy("t").agg(F.first("id", ignorenulls=True).alias("id"), *sums[:3])
    n = F.col("words")
    unit = F.log(F.lit(discount)) - lower(F.lit(total) - (n if left_out else F.lit(0)))
    x = x.select("id", n.alias("n"), "backed", F.round(F.col("part") + F.col("backed") * unit, 6).alias("s"))
    return x.select(F.col("id").alias(id_col), F.col("n").alias("n_words"), F.col("n").alias("n_grams"), F.col("backed").alias("n_backed_off"), F.col("s").alias("log_score"), F.when(F.col("n") > 0, F.round(F.col("s") / F.col("n"), 9)).alias("mean_log_score"))


def score_against(docs: DataFrame, corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text", common: int = 1_000_000, dense: int = 1024, discount: float = DISCOUNT) -> DataFrame:
    """``id_col, n_words, n_grams, n_backed_off, log_score, mean_log_score`` for each row of ``docs`` under the counts of the
    words of ``corpus`` (same text column).

    ``mean_log_score`` is per word, in natural logarithms. ``common, dense``: sizes of the broadcast tables of counts,
    below 2^20 words and 8 bytes a pair.
    """
    return _score(docs, corpus, False, id_col, text_col, common, dense, discount)


def score_left_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", common: int = 1_000_000, dense: int = 1024, discount: float = DISCOUNT) -> DataFrame:
    """As :func:`score_against`, for each row under the counts of all the other rows."""
    return _score(docs, docs, True, id_col, text_col, common, dense, discount)
