"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves a pre-token that is itself a vocabulary entry to its id (a
pre-token that is an entry is a fixed point of the merges for a vocabulary trained by merges). Tier two: any other
pre-token is merged from its bytes with a heap of candidate pairs over a doubly linked list, always the pair of lowest
rank first and the leftmost of equals, as the reference tokenizers do.

The hash is of the hash-and-displace kind: keys fall into buckets, and from the largest bucket down each finds the first
seed that sends its keys to free places of a table exactly as large as the vocabulary. It is built once on the driver and
broadcast; its size is fixed by the vocabulary. Resolved pre-tokens are remembered for a bounded number of them.

Defined cases: null and empty texts encode to no ids and decode to no bytes; a vocabulary without some byte raises
KeyError when that byte is met; repeated rows are encoded alike; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.llm.common import kept, slices

_MEMO = 300_000


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file in the order of their ranks (0, 1, 2, ...)."""
    with open(path, "rb") as f:
        rows = [line.split() for line in f if line.strip()]
    out = [b""] * len(rows)
    for token, rank in rows:
        out[int(rank)] = base64.b64decode(token)
    return out


@dataclass(frozen=True)
class PerfectHash:
    """``seeds`` of the buckets, and for each place the id of its key."""

    seeds: np.ndarray
    ids: np.ndarray

    @classmethod
    def build(cls, keys: list[bytes], load: int = 4) -> PerfectHash:
        n, n_buckets = len(keys), max(1, len(keys) // load)
        buckets: list[list[int]] = [[] for _ in range(n_buckets)]
        for i, k in enumerate(keys):
            buckets[xxhash.xxh3_64_intdigest(k) % n_buckets].append(i)
        seeds, ids = np.zeros(n_buckets, np.int64), np.full(n, -1, np.int64)
        free = iter(())
        for b in sorted(range(n_buckets), key=lambda b: -len(buckets[b])):
            own = buckets[b]
            if len(own) == 1:  # single keys take the places left, named directly by a negative seed
                if not isinstance(free, list):
                    free = np.flatnonzero(ids < 0).tolist()
                place = free.pop()
                seeds[b], ids[place] = -place - 1, own[0]
                continue
            seed = 0
            while own:
                seed += 1
                places = {xxhash.xxh3_64_intdigest(keys[i], seed) % n for i in own}
                if len(places) == len(own) and all(ids[p] < 0 for p in places):
                    for i in own:
                        ids[xxhash.xxh3_64_intdigest(keys[i], seed) % n] = i
                    seeds[b] = seed
                    break
        return cls(seeds, ids)

    def candidate(self, key: bytes) -> int:
        """The only id whose key can equal ``key``; the caller compares."""
        seed = int(self.seeds[xxhash.xxh3_64_intdigest(key) % len(self.seeds)])
        place = -seed - 1 if seed < 0 else xxhash.xxh3_64_intdigest(key, seed) % len(self.ids)
        return int(self.ids[place])


class Bpe:
    """Encodes and decodes; ``vocab[i]`` is the byte string of id i."""

    def __init__(self, vocab: list[bytes], pattern: str, table: PerfectHash | None = None):
        self.vocab = vocab
        self.table = table or PerfectHash.build(vocab)
        self.split = regex.compile(pattern).findall
        self.ranks = {v: i for i, v in enumerate(vocab)}  # of the parts that merges make
        self.memo: dict[str, tuple[int, ...]] = {}

    def rank(self, piece: bytes) -> int | None:
        i = self.table.candidate(piece)
        return i if i >= 0 and self.vocab[i] == piece else None

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Heap over linked bytes: (rank, start, end) of pairs; ``end[i]`` is where the part that starts at i ends."""
        get, n = self.ranks.get, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            j = end[i]
            if j <= 0 or j >= n or end[j] != stop:
                continue  # one of the two has been merged since
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := get(piece[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := get(piece[h:stop])) is not None:
                heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def pre_token(self, token: str) -> tuple[int, ...]:
        piece = token.encode("utf-8")
        whole = self.rank(piece)
        return (whole,) if whole is not None else self.merge(piece)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        memo, tokens, out = self.memo, self.split(text), []
        if len(memo) > _MEMO:
            memo.clear()
        for t in tokens:
            ids = memo.get(t)
            if ids is None:
                ids = self.pre_token(t)
                if len(t) < 64:
                    memo[t] = ids
            out.extend(ids)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))


def _mapped(docs: DataFrame, id_col: str, text_col: str, vocab: list[bytes], pattern: str, columns: str, row) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((vocab, PerfectHash.build(vocab)))
    name = ("bpe", pattern, hashlib.sha256(b"\n".join(vocab)).hexdigest())
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, table = shared.value
        bpe = kept(name, lambda: Bpe(words, pattern, table))
        text = [str(i) for i in range(len(words))]
        names = [c.split()[0] for c in columns.split(",")]
        for b in slices(batches):
            yield pd.DataFrame({id_col: b["k"]} | dict(zip(names, zip(*[row(bpe, text, t) for t in b["t"]], strict=True), strict=True)) if len(b) else {id_col: b["k"]} | {n: [] for n in names})

    return docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t")).mapInPandas(run, f"`{id_col}` {kind}, {columns}")


def encode(docs: DataFrame, vocab: list[bytes], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids`` (array of int) for each row."""
    return _mapped(docs, id_col, text_col, vocab, pattern, "ids array<int>", lambda bpe, _, t: (bpe.encode(t),))


def round_trip_digests(docs: DataFrame, vocab: list[bytes], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256``: encoded, then decoded, without moving the ids between processes."""

    def row(bpe: Bpe, text: list[str], t: str | None) -> tuple:
        ids = bpe.encode(t)
        return len(ids), hashlib.sha256(" ".join(map(text.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()

    return _mapped(docs, id_col, text_col, vocab, pattern, "n_tokens long, ids_sha256 string, decoded_sha256 string", row)
