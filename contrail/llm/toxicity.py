"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

A text's features are the hashed character n-grams (3 to 5 characters, word ends marked) of its lower-case words; each
counts once however often it occurs. ``r = log((p/|p|)/(q/|q|))`` of the smoothed document counts in both classes
scales a feature; a logistic regression with L2 penalty learns on the scaled features.

Training reads a bounded sample of the labelled rows (about ``max_rows_per_class``, a hash of the id decides) and runs on the
driver. The sample's n-grams are bounded too: if they took more than ``max_bytes``, as with very long texts, a smaller share
of the rows is taken, again by a hash of the id; no row has more than one number for each hash bucket. The model is one float for each hash bucket, broadcast at a fixed size of ``buckets * 4`` bytes. Scoring is one
pass without a shuffle.

Defined cases: null and empty texts, and texts without a word, get the score of a text with no features; repeated rows
are scored alike; with no labelled rows of one of the classes the score is 0.5 less an epsilon (predicted 0) everywhere;
other columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.llm.common import bounded_sample, drop_stored, held_out, slices, stored, uniform

_WORDS = re.compile(r"[^\W_]+")
_MEMO = 200_000
_BLOCK = 1_000_000  # n-grams of a block of training rows


@dataclass(frozen=True)
class Toxicity:
    """Weights for each bucket (already multiplied by the log-count ratios) and the intercept."""

    weights: np.ndarray
    bias: float


class Features:
    """Hashed n-grams of words, remembered for a bounded number of words."""

    def __init__(self, buckets: int, low: int, high: int):
        self.buckets, self.low, self.high = buckets, low, high
        self.memo: dict[str, np.ndarray] = {}
        self.stamp = np.zeros(buckets, np.int64)

    def of_word(self, word: str) -> np.ndarray:
        marked = f"^{word}$".encode()
        n, mask, crc = len(marked), self.buckets - 1, zlib.crc32
        return np.array([crc(marked[i : i + k]) & mask for k in range(self.low, self.high + 1) for i in range(n - k + 1)], np.int32)

    def of_text(self, text: str | None) -> np.ndarray:
        words = set(_WORDS.findall(text.lower())) if text else ()
        memo, parts = self.memo, []
        for w in words:
            found = memo.get(w)
            if found is None:
                if len(memo) >= _MEMO:
                    memo.clear()
                found = memo[w] = self.of_word(w)
            parts.append(found)
        if not parts:
            return np.zeros(0, np.int32)
        ids = np.concatenate(parts)
        order = np.arange(len(ids))
        self.stamp[ids] = order  # the last of equal ids wins: one of each stays
        return ids[self.stamp[ids] == order]


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def fit_arrays(rows: list[np.ndarray], labels: np.ndarray, buckets: int, alpha: float = 1.0, penalty: float = 2e-3, steps: int = 100) -> Toxicity:
    """Log-count ratios, then logistic regression on the scaled features by Adam steps over all rows."""
    y = np.asarray(labels, float)
    if len(y) == 0 or y.min() == y.max():
        return Toxicity(np.zeros(buckets, np.float32), -1e-6)
    sizes = np.array([len(x) for x in rows])
    ids = np.concatenate(rows).astype(np.int32)
    ends = np.cumsum(sizes)
    # rows in blocks of bounded size, each with its part of ids: what a step computes is never larger than a block
    cuts = [0, *(np.flatnonzero(np.diff(ends // _BLOCK)) + 1).tolist(), len(y)]
    blocks = [(i, j, slice(ends[i] - sizes[i], ends[j - 1])) for i, j in zip(cuts, cuts[1:]) if i < j]
    of = lambda values, i, j: np.repeat(values[i:j], sizes[i:j])
    p, q = np.full(buckets, alpha), np.full(buckets, alpha)
    for i, j, part in blocks:
        p += np.bincount(ids[part], weights=of(y, i, j), minlength=buckets)
        q += np.bincount(ids[part], weights=of(1 - y, i, j), minlength=buckets)
    used = np.flatnonzero(p + q > 2 * alpha)
    ratio = np.log((p / (y.sum() + 2 * alpha)) / (q / ((1 - y).sum() + 2 * alpha)))[used]
    place = np.zeros(buckets, np.int32)
    place[used] = np.arange(len(used))
    ids = place[ids]
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())  # both classes weigh alike
    w, b = np.zeros(len(used)), 0.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, steps + 1):
        scaled, sums, slope = w * ratio, np.zeros(len(used)), 0.0
        for i, j, part in blocks:
            z = np.bincount(np.repeat(np.arange(j - i), sizes[i:j]), weights=scaled[ids[part]], minlength=j - i) + b
            g = share[i:j] * (_sigmoid(z) - y[i:j])
            sums += np.bincount(ids[part], weights=np.repeat(g, sizes[i:j]), minlength=len(used))
            slope += g.sum()
        grad = np.append(ratio * sums + penalty * w, slope)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    weights = np.zeros(buckets, np.float32)
    weights[used] = w * ratio
    return Toxicity(weights, float(b))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows_per_class: int = 1500, buckets: int = 1 << 18, low: int = 3, high: int = 5, max_bytes: int = 64 << 20) -> Toxicity:
    """Learn from at most about ``max_rows_per_class`` rows of each class and ``max_bytes`` of their n-grams, four bytes each.
    Rows with a null label are left out."""
    rows = labelled.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"), F.col(label_col).cast("int").alias("y")).where("y is not null")
    rows = bounded_sample(rows, "y", "k", max_rows_per_class)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = Features(buckets, low, high)
        for b in slices(batches):
            yield pd.DataFrame({"y": b["y"], "k": b["k"].astype("string"), "x": [f.of_text(t).tobytes() for t in b["t"]]})

    sample = stored(rows.mapInPandas(features, "y int, k string, x binary"))
    size = sample.agg(F.sum(F.length("x"))).first()[0] or 0
    if size > max_bytes:
        sample = sample.where(uniform("k", "x", seed=1) < max_bytes / size)
    got = sorted(sample.collect(), key=lambda r: (r["k"] or "", len(r["x"]), zlib.crc32(r["x"])))
    drop_stored(sample)
    return fit_arrays([np.frombuffer(r["x"], np.int32) for r in got], np.array([1 if r["y"] == 1 else 0 for r in got]), buckets)


def score(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text", low: int = 3, high: int = 5) -> DataFrame:
    """``id_col, score, predicted`` for each row of ``docs``; score from 0 to 1, predicted 1 from 0.5."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.weights, model.bias))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, bias = shared.value
        f = Features(len(weights), low, high)
        for b in slices(batches):
            z = np.array([float(weights[f.of_text(t)].sum(dtype=np.float64)) for t in b["t"]], float) + bias
            s = _sigmoid(z)
            yield pd.DataFrame({id_col: b["k"], "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    return docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t")).mapInPandas(run, f"`{id_col}` {kind}, score double, predicted int")


def labelled_rows(docs: DataFrame, labels: DataFrame, label_col: str = "toxic") -> DataFrame:
    """Training rows ``doc_id, text, label``: labelled and not held out. A label repeated with conflicting values counts as its larger value."""
    marks = labels.where(~held_out("doc_id")).groupBy("doc_id").agg(F.max(label_col).alias("__label")).where("__label is not null")
    return docs.select("doc_id", "text").where(~held_out("doc_id")).join(marks, "doc_id").withColumnRenamed("__label", label_col)
