"""Language ID: unigram piece models for each language, marginalised over all segmentations.

A fixed public vocabulary gives the pieces. For each language every piece has a probability; a word's probability is the
sum, over all ways to cut it into pieces, of the product of the pieces' probabilities (a forward pass, no best path). A
text's log likelihood is the sum over its words; the language with the largest one wins and ``score`` is its posterior
under equal priors.

Training is expectation-maximisation: the forward-backward pass over a table of word counts gives each piece's expected
count in each language; Spark sums them, and only the vocabulary x languages matrix comes to the driver. The word counts
are of a bounded sample of the labelled texts (``docs_per_language``, chosen by a hash of the id).

Letters alone count: words are runs of letters (Unicode category L), in lower case. However long a run is, it is summed
whole: the forward pass keeps as many sums as the longest piece has letters, rescaled at every letter. Training takes its
expected counts from stretches of 32 letters. A letter no piece covers costs a fixed small probability in every language.

Defined cases: a null text and one without a letter (digits, numerals such as ``½`` or ``①``, marks) give ``und`` with score 0; if nothing is labelled every text does;
ties go to the language first by code point; repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.llm.common import bounded_sample, drop_stored, slices, stored

UND = "und"
_WORDS = re.compile(r"[^\W\d_]+")
_STRETCH = 32
_CHUNK = 4096
_MEMO = 250_000  # words remembered
_MEMO_LETTERS = 8_000_000
_FLOOR = 1e-8
_BASE = np.uint64(0x9E3779B97F4A7C15)


def letter_runs(text: str) -> list[str]:
    """The words of a text in lower case. ``\\w`` also takes numerals, which end a word here."""
    found = _WORDS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [r for w in found for r in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def vocabulary(path: str) -> list[str]:
    """The distinct lower-case pieces of a SentencePiece model that are letters (with or without the word-start mark)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
    return sorted(p for p in pieces if p.replace("▁", "a", 1).isalpha() and len(p) <= _STRETCH)


def _codes(words: list[str], width: int) -> np.ndarray:
    """Code points, a row for each word, 0 after its end."""
    flat = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32)
    return flat.reshape(len(words), width).astype(np.uint64)


class Pieces:
    """Finds vocabulary pieces at every place of many words at once, by a rolling hash for each length."""

    def __init__(self, vocab: list[str]):
        self.size = len(vocab)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(vocab):
            by_length.setdefault(len(p), []).append(i)
        for n, ids in by_length.items():
            code = _codes([vocab[i] for i in ids], n)
            h = np.zeros(len(ids), np.uint64)
            for k in range(n):
                h = h * _BASE + code[:, k] + np.uint64(1)
            order = np.argsort(h)
            self.tables[n] = h[order], np.array(ids)[order]
        self.longest = max(self.tables, default=0)

    def at(self, code: np.ndarray) -> dict[int, np.ndarray]:
        """For each length n, ids of the pieces that start at each place (``size``: none)."""
        out, h = {}, np.zeros(code.shape, np.uint64)
        for n in range(1, min(self.longest, code.shape[1]) + 1):
            h = h[:, : code.shape[1] - n + 1] * _BASE + code[:, n - 1 :] + np.uint64(1)
            if n in self.tables:
                keys, ids = self.tables[n]
                spot = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                out[n] = np.where(keys[spot] == h, ids[spot], self.size)
        if 1 not in out:
            out[1] = np.full(code.shape, self.size)
        return out


def _forward(found: dict[int, np.ndarray], p: np.ndarray, width: int) -> np.ndarray:
    """alpha[e]: the summed probability of all segmentations of the first e letters, for each word and language."""
    rows = found[1].shape[0]
    alpha = np.zeros((width + 1, rows, p.shape[1]))
    alpha[0] = 1.0
    for e in range(1, width + 1):
        for n, ids in found.items():
            if n <= e:
                part = p[ids[:, e - n]]
                if n == 1:
                    part = np.maximum(part, _FLOOR)
                alpha[e] += alpha[e - n] * part
    return alpha


def _backward(found: dict[int, np.ndarray], p: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """beta[s]: the same for the letters after the first s, up to each word's own end."""
    beta = np.zeros((width + 1, len(length), p.shape[1]))
    for s in range(width, -1, -1):
        beta[s][length == s] = 1.0
        for n, ids in found.items():
            if s + n <= width:
                part = p[ids[:, s]]
                if n == 1:
                    part = np.maximum(part, _FLOOR)
                beta[s] += np.where((s + n <= length)[:, None], part * beta[s + n], 0.0)
    return beta


def stretches(word: str) -> list[str]:
    """The word, marked at its start, in parts of bounded length."""
    marked = "▁" + word
    return [marked[i : i + _STRETCH] for i in range(0, len(marked), _STRETCH)]


def _long_log_likelihood(word: str, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """One marked word of any length, for each language. ``ahead[i]`` is what the pieces so far give the place i letters on;
    it is divided by the sum of the place at hand, whose logarithm adds up."""
    ahead, logs = np.zeros((max(1, pieces.longest) + 1, p.shape[1])), np.zeros(p.shape[1])
    ahead[0] = 1.0
    n_ring = len(ahead)
    for start in range(0, len(word), _CHUNK):
        stop = min(len(word), start + _CHUNK)
        part = word[start : stop + max(0, pieces.longest - 1)]
        found = pieces.at(_codes([part], len(part)))
        hits: list[list[tuple[int, int]]] = [[] for _ in range(stop - start)]
        for n, ids in found.items():
            own = ids[0, : stop - start]
            for s in np.flatnonzero(own != pieces.size) if n > 1 else range(len(own)):
                hits[s].append((n, int(own[s])))
        for s, pairs in enumerate(hits):
            i = (start + s) % n_ring
            now = ahead[i].copy()
            logs += np.log(now)
            ahead /= now
            ahead[i] = 0.0
            for n, piece in pairs:
                ahead[(i + n) % n_ring] += np.maximum(p[piece], _FLOOR) if n == 1 else p[piece]
    return logs + np.log(ahead[len(word) % n_ring])


def log_likelihoods(words: list[str], pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """A row for each marked word, a column for each language. ``p`` has a last row of zeros for "no piece"."""
    out = np.zeros((len(words), p.shape[1]))
    order = sorted((i for i, w in enumerate(words) if len(w) <= _STRETCH), key=lambda i: len(words[i]))
    for at in range(0, len(order), 4096):
        own = order[at : at + 4096]
        some = [words[i] for i in own]
        width = len(some[-1])
        alpha = _forward(pieces.at(_codes(some, width)), p, width)
        length = np.array([len(w) for w in some])
        out[own] = np.log(alpha[length, np.arange(len(own))])
    for i, w in enumerate(words):
        if len(w) > _STRETCH:
            out[i] = _long_log_likelihood(w, pieces, p)
    return out


@dataclass(frozen=True)
class LanguageModel:
    """Languages in code point order, the vocabulary, and a probability for each piece (rows) and language (columns)."""

    languages: list[str]
    vocab: list[str]
    p: np.ndarray


def _expected(words: list[str], counts: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Expected piece counts of one language's words; ``p`` has one column."""
    total = np.zeros(pieces.size + 1)
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    for at in range(0, len(order), 4096):
        own = order[at : at + 4096]
        some = [words[i] for i in own]
        width = len(some[-1])
        length = np.array([len(w) for w in some])
        found = pieces.at(_codes(some, width))
        a, b = _forward(found, p, width), _backward(found, p, length, width)
        weight = counts[own] / a[length, np.arange(len(own)), 0]
        for n, ids in found.items():
            for s in range(width - n + 1):
                total += np.bincount(ids[:, s], weights=a[s, :, 0] * p[ids[:, s], 0] * b[s + n, :, 0] * weight, minlength=pieces.size + 1)
    return total[:-1]


def fit(docs: DataFrame, vocab: list[str], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 1000, rounds: int = 3) -> LanguageModel:
    """Learn piece probabilities from about ``docs_per_language`` texts of each language (all if there are fewer)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and t is not null")
    sample = bounded_sample(rows, "lang", "k", docs_per_language)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            for lang, texts in b.groupby("lang")["t"]:
                c = Counter(w for t in texts for w in letter_runs(t))
                parts: Counter = Counter()
                for w, n in c.items():
                    for s in stretches(w):
                        parts[s] += n
                if parts:
                    yield pd.DataFrame({"lang": lang, "w": list(parts), "n": list(parts.values())})

    words = stored(sample.select("lang", "t").mapInPandas(count, "lang string, w string, n long").groupBy("lang", "w").agg(F.sum("n").alias("n")))
    languages = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    p = np.full((len(vocab) + 1, max(1, len(languages))), 1.0 / max(1, len(vocab)))
    p[-1] = 0.0
    for _ in range(rounds if languages else 0):
        shared = spark.sparkContext.broadcast((vocab, languages, p))

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            v, langs, probs = shared.value
            pieces, sums = Pieces(v), {}
            for b in slices(batches):
                for lang, g in b.groupby("lang"):
                    j = langs.index(lang)
                    sums[j] = sums.get(j, 0) + _expected(list(g["w"]), g["n"].to_numpy(float), pieces, probs[:, j : j + 1])
            for j, c in sums.items():
                hit = np.flatnonzero(c)
                yield pd.DataFrame({"j": np.int32(j), "piece": hit.astype(np.int32), "c": c[hit]})

        got = words.mapInPandas(expect, "j int, piece int, c double").groupBy("j", "piece").agg(F.sum("c").alias("c")).toPandas()
        counts = np.full((len(vocab), len(languages)), 0.01)
        counts[got["piece"].to_numpy(), got["j"].to_numpy()] += got["c"].to_numpy()
        p = np.vstack([counts / counts.sum(axis=0), np.zeros((1, len(languages)))])
    drop_stored(words)
    return LanguageModel(languages, vocab, p)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score`` for each row of ``docs``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.languages, model.vocab, model.p))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        languages, vocab, p = shared.value
        pieces, memo, letters, table = Pieces(vocab), {}, 0, np.zeros((0, max(1, len(languages))))
        for b in slices(batches):
            texts = [letter_runs(t) if t is not None else [] for t in b["t"]]
            new = list(dict.fromkeys(w for ws in texts for w in ws if w not in memo))
            if new:
                if len(memo) + len(new) > _MEMO or letters > _MEMO_LETTERS:
                    memo, letters, table = {}, 0, table[:0]
                    new = list(dict.fromkeys(w for ws in texts for w in ws))
                rows = log_likelihoods(["▁" + w for w in new], pieces, p)
                memo.update(zip(new, range(len(table), len(table) + len(new)), strict=True))
                letters += sum(map(len, new))
                table = np.vstack([table, rows])
            names, scores = [], []
            for ws in texts:
                if not ws or not languages:
                    names.append(UND)
                    scores.append(0.0)
                    continue
                total = table[np.fromiter(map(memo.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
                best = int(total.argmax())
                names.append(languages[best])
                scores.append(float(1.0 / np.exp(np.maximum(total - total[best], -700)).sum()))
            yield pd.DataFrame({id_col: b["k"], "lang_pred": names, "score": scores})

    return docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t")).mapInPandas(run, f"`{id_col}` {kind}, lang_pred string, score double")
