"""Benchmark decontamination: a distributed positional inverted index of whole texts, searched for phrases of test items.

The index is a stored table of blocks of documents. A block holds, for all words of its documents, the sorted terms (64-bit
hashes of words), how often each occurs, and each term's postings: its positions in the block, as differences. Documents
follow each other in one order of positions with a gap between two, so a posting names its document too. Blocks are made
where the texts are read: nothing is shuffled, a very frequent word's list is spread over all blocks, and a block's size is
bounded by its bytes of text (or one text, if that is longer).

A phrase is a window of consecutive words of a test item. In each block a phrase is out at once if one of its terms has no
list there. Else the list of its rarest term in the block is turned into starts (posting less the term's place in the
phrase), and these are intersected with the lists of the other terms, from rare to frequent, each shifted by its own place:
what is left are exact occurrences. With ``slop`` a term may be that many words off its place (within the document), which
gives proximity matches; a word may then stand for two equal ones of the phrase.

Phrases meet the index in parts of at most about ``part`` of them, each broadcast; more phrases take more passes. What a
block emits is a row for each document: merged spans of words that are hit, and the items found.

Words are named by hashes: two different words of a corpus share one with probability about 2^-63 for each pair.

Defined cases: a null text has no words, an empty one neither; a null or repeated document id is a row like any other; an
item without words has no window; texts of items that share an id count as one item, and an item whose id is null marks
words but is not counted or named; without items nothing is hit; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.llm.common import slices, stored

_INDEX = "block long, ids array<long>, firsts binary, terms binary, counts binary, postings binary"
_FOUND = "block long, doc int, id long, n_words long, spans array<struct<a:long,b:long>>, items array<long>"
_CANDIDATES = 1 << 21  # starts that a task looks at together


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of joined UTF-8 texts: runs of 0-9, a-z (A-Z lower-cased) and of bytes of other than ASCII characters.

    A word's hash is a polynomial in an odd number over random values of its bytes, from sums over the whole text."""

    def __init__(self):
        byte = np.arange(256)
        upper = (byte >= 65) & (byte <= 90)
        self.inside = (byte >= 128) | ((byte >= 48) & (byte <= 57)) | ((byte >= 97) & (byte <= 122)) | upper
        value = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.value = np.where(upper, value[np.where(upper, byte + 32, 0)], value)
        self.base = 0xD1342543DE82EF95 | 3
        self.powers, self.inverses = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        """Powers of the base and of its inverse up to n."""
        if len(self.powers) < n:
            n = max(n, 1 << 20)
            for name, base in (("powers", self.base), ("inverses", pow(self.base, -1, 1 << 64))):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and the number of the first word of each text (and one past the last word)."""
        buf = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
        inside = self.inside[buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        begin, end = edge[::2], edge[1::2]
        self._grow(len(buf))
        sums = np.cumsum(self.value[buf] * self.powers[: len(buf)])
        hashes = _mixed((sums[end - 1] - sums[begin - 1]) * self.inverses[begin])
        at = np.cumsum([1, *[len(t) + 1 for t in texts]])
        return hashes, np.searchsorted(begin, at)


def _shuffled(x: np.ndarray) -> bytes:
    """32-bit numbers, byte by byte: high bytes are nearly all alike, so that the table's compression takes them away."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unshuffled(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _posted(hashes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted terms, their numbers of postings, and the postings as differences within a term."""
    n = len(hashes)
    place = np.arange(n) + np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))  # one place free after each document
    order = np.argsort(hashes, kind="stable")
    h, p = hashes[order], place[order]
    heads = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if n else np.zeros(0, np.int64)
    step = np.diff(p, prepend=0)
    step[heads] = p[heads]
    return h[heads], np.diff(np.append(heads, n)), step


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """The index of all words of ``docs``: a stored table of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, words = TaskContext.get().partitionId() << 32, Words()
        for part in slices(batches):
            ids, texts = part.column(0).to_pylist(), [t or b"" for t in part.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                to, size = at + 1, len(texts[at])
                while to < len(texts) and size + len(texts[to]) <= block_bytes:
                    size += len(texts[to])
                    to += 1
                hashes, firsts = words.of(texts[at:to])
                terms, counts, steps = _posted(hashes, firsts)
                row = [number, ids[at:to], _shuffled(firsts), terms.tobytes(), _shuffled(counts), _shuffled(steps)]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, (pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4), strict=True)], ["block", "ids", "firsts", "terms", "counts", "postings"])
                number, at = number + 1, to

    return stored(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, _INDEX))


def phrases(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = 10) -> DataFrame:
    """``id, terms``: each window of ``size`` consecutive words of an item, or all its words if it has fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for part in slices(batches):
            for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                h, _ = words.of([t or b""])
                if len(h):
                    w = np.lib.stride_tricks.sliding_window_view(h, min(size, len(h)))
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(w), pa.int64()), pa.array([x.tobytes() for x in w], pa.binary())], ["id", "terms"])

    found = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, "id long, terms binary")
    return stored(found.distinct())


class Block:
    """A block of the index, opened for a search."""

    def __init__(self, row: dict):
        self.ids, self.firsts = row["ids"], _unshuffled(row["firsts"]).astype(np.int64)
        self.terms, self.counts = np.frombuffer(row["terms"], np.uint64), _unshuffled(row["counts"]).astype(np.int64)
        steps = np.cumsum(_unshuffled(row["postings"]).astype(np.int64))
        self.heads = np.append(0, np.cumsum(self.counts))[:-1]
        before = np.append(0, steps)[self.heads]
        self.places = steps - np.repeat(before, self.counts)
        #: Sorted by term, then place.
        self.keys = (np.repeat(np.arange(len(self.terms)), self.counts) << 32) | self.places
        self.doc_begin = self.firsts[:-1] + np.arange(len(self.ids))
        self.doc_end = self.firsts[1:] + np.arange(len(self.ids))

    def _candidates(self, idx: np.ndarray, rare: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Phrases, places of their rarest terms and starts, a bounded number at a time."""
        term = idx[np.arange(len(idx)), rare]
        n = self.counts[term]
        part = np.cumsum(n) * (2 * slop + 1) // _CANDIDATES
        for g in np.split(np.arange(len(idx)), np.flatnonzero(np.diff(part)) + 1):
            which = np.repeat(g, n[g])
            nth = np.arange(len(which)) - np.repeat(np.cumsum(n[g]) - n[g], n[g])
            at = self.places[self.heads[term[which]] + nth]
            for off in range(-slop, slop + 1):
                yield which, at, at - rare[which] + off

    def search(self, terms: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of ``terms`` (phrases of one length), the documents that hold them and the places where they begin: all
        words of the phrase are within ``slop`` words of their places, counted from there, in that document."""
        none = (np.zeros(0, np.int64),) * 3
        if not len(self.terms) or not len(terms):
            return none
        idx = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        there = np.flatnonzero((self.terms[idx] == terms).all(1))
        if not len(there):
            return none
        idx = idx[there]
        order = np.argsort(self.counts[idx], axis=1, kind="stable")
        found = []
        for which, at, start in self._candidates(idx, order[:, 0], slop):
            doc = np.searchsorted(self.doc_begin, at, "right") - 1
            ok = (start >= self.doc_begin[doc] - slop) & (start + terms.shape[1] <= self.doc_end[doc] + slop)
            which, start, doc = which[ok], start[ok], doc[ok]
            for j in range(1, terms.shape[1]):
                place = order[which, j]
                key, want = idx[which, place] << 32, start + place
                first = np.searchsorted(self.keys, key | np.maximum(want - slop, self.doc_begin[doc]))
                ok = self.keys[np.minimum(first, len(self.keys) - 1)] <= (key | np.minimum(want + slop, self.doc_end[doc] - 1))
                ok &= first < len(self.keys)
                which, start, doc = which[ok], start[ok], doc[ok]
            found.append((there[which], doc, start))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def found(self, parts: list[tuple[np.ndarray, np.ndarray]], slop: int) -> dict[int, tuple[list, set]]:
        """Of each document with a match the merged spans of its words, and the items; ``parts``: terms and items by length."""
        cover, named = np.zeros(int(self.firsts[-1]) + len(self.ids) + 1, np.int64), {}
        for terms, items in parts:
            which, doc, start = self.search(terms, slop)
            np.add.at(cover, np.maximum(start, self.doc_begin[doc]), 1)
            np.add.at(cover, np.minimum(start + terms.shape[1], self.doc_end[doc]), -1)
            for d, i in set(zip(doc.tolist(), items[which].tolist(), strict=True)):
                named.setdefault(d, set()).add(i)
        edge = np.diff((np.cumsum(cover) > 0).astype(np.int8), prepend=0)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        out = {d: ([], items) for d, items in named.items()}
        for d, a, b in zip((np.searchsorted(self.doc_begin, begin, "right") - 1).tolist(), begin.tolist(), end.tolist(), strict=True):
            out[d][0].append({"a": a - int(self.doc_begin[d]), "b": b - int(self.doc_begin[d])})
        return out


def _pass(index: DataFrame, parts, slop: int, every: bool) -> DataFrame:
    """A row for each document with a match (or for ``every`` document) under one part of the phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                b = Block(row)
                hits, sizes = b.found(parts.value, slop), np.diff(b.firsts).tolist()
                docs = range(len(b.ids)) if every else sorted(hits)
                spans, items = zip(*[hits.get(d, ([], set())) for d in docs], strict=True) if len(docs) else ((), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]] * len(docs), pa.int64()), pa.array(docs, pa.int32()), pa.array([b.ids[d] for d in docs], pa.int64()), pa.array([sizes[d] for d in docs], pa.int64()), pa.array(list(spans), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array([[i for i in x if i is not None] for x in items], pa.list_(pa.int64()))],
                    ["block", "doc", "id", "n_words", "spans", "items"],
                )

    return index.mapInArrow(run, _FOUND)


def covered(spans: str) -> Column:
    """How many words the spans hold together."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))

    def add(acc: Column, s: Column) -> Column:
        to = F.greatest(acc["to"], s["b"])
        return F.struct((acc["n"] + to - F.greatest(acc["to"], F.least(s["a"], to))).alias("n"), to.alias("to"))

    return F.aggregate(F.array_sort(spans), start, add)["n"]


def search(index: DataFrame, wanted: DataFrame, slop: int = 0, part: int = 200_000) -> DataFrame:
    """``id, n_words, spans, items``: one row for each document of the index; spans of words from ``a`` up to before ``b``
    (disjoint under one part of the phrases), and the distinct ids of items with a phrase in it.

    ``part``: about how many phrases (80 bytes each for ten words) are broadcast at a time.
    """
    spark = index.sparkSession
    passes = -(-wanted.count() // part) or 1
    frames = []
    for k in range(passes):
        mine = wanted.where(F.pmod(F.xxhash64("terms", "id"), F.lit(passes)) == k).toArrow()
        lengths = np.array([len(t) // 8 for t in mine["terms"].to_pylist()], np.int64)
        ids = np.array(mine["id"].to_pylist(), object)
        bytes_ = mine["terms"].to_pylist()
        groups = [(np.frombuffer(b"".join(bytes_[i] for i in rows), np.uint64).reshape(len(rows), n), ids[rows]) for n in np.unique(lengths).tolist() for rows in [np.flatnonzero(lengths == n)]]
        frames.append(_pass(index, spark.sparkContext.broadcast(groups), slop, k == 0))
    if passes == 1:
        return frames[0].select("id", "n_words", "spans", "items")
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    met = out.groupBy("block", "doc").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return met.select("id", "n_words", "spans", "items")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, slop: int = 0, part: int = 200_000, block_bytes: int = 4 << 20) -> DataFrame:
    """``id, n_words, n_hit, items``: words of each document, how many of them are in an occurrence of an item's window, and
    the items with such windows."""
    found = search(build(docs, id_col, text_col, block_bytes), phrases(items, item_id, item_text, size), slop, part)
    return found.select(F.col("id").alias(id_col), "n_words", covered("spans").alias("n_hit"), "items")
