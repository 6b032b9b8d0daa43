"""The pipeline's stages on odd rows, and run() against a brute-force version of what its decisions lead to."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe

import corpus_pipeline
from contrail.llm import language_id, toxicity
from contrail.llm.common import held_out
from tests.llm.test_native import fill
from tests.llm.test_near_dup import classes

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)
ODD = [(10**9, None, "en", "web", 0), (10**9 + 1, "", None, None, 0), (None, "½ ① 12", "de", "web", 6), (None, None, None, None, None), (10**9 + 2, "the cat sat on the mat and was not seen again " * 2000, "en", "web", 96_000), (10**9 + 3, "the weather of the day was fine and the garden was full of people", "en", None, 66)]
ODD += [ODD[-1], ODD[0]]


def docs_of(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)


def odd(spark):
    """The given documents, odd rows and repeats, and columns whose names the stages use themselves."""
    rows = docs_of(spark).union(spark.createDataFrame(ODD, SCHEMA))
    return rows.selectExpr("*", "1 as key", "2 as rank", "3 as root", "4 as size", "5 as row", "6 as score", "7 as copy", "8 as target", "'x' as spread")


def counted(df):
    return Counter(tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in df.select(*corpus_pipeline.COLUMNS).collect())


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_table(spark, name):
    got = STAGES[name](spark, odd(spark).limit(0), SF)
    assert got.count() == 0 and (name == "bpe" or got.columns == corpus_pipeline.COLUMNS)


def test_language_stage(spark):
    """Texts without a letter go, all others stay as often as they are there."""
    before, got = counted(odd(spark)), counted(STAGES["language_id"](spark, odd(spark), SF))
    assert not got - before
    gone = before - got
    assert all(k not in got for k in gone)  # repeated rows share a fate
    letterless = [k for k in before if not any(c.isalpha() for c in k[1] or "")]
    assert set(letterless) <= set(gone) and len(gone) <= len(letterless) + 0.02 * len(before)


def test_toxicity_stage(spark):
    before, got = counted(odd(spark)), counted(STAGES["toxicity"](spark, odd(spark), SF))
    assert not got - before and all(k not in got for k in before - got)
    assert {ODD[0], ODD[1], ODD[3], ODD[5]} <= set(got) and sum(got.values()) > 0.8 * sum(before.values())


def test_mixing_stage(spark):
    """A row comes as often as the operator takes it, at most three times; words come near each source's target."""
    rows, got = counted(odd(spark)), counted(STAGES["mixing"](spark, odd(spark), SF))
    assert set(got) <= set(rows) and all(n <= 3 * rows[k] for k, n in got.items())
    size = lambda t: len((t or "").split())
    by, taken, most = Counter(), Counter(), Counter()
    for k, n in rows.items():
        by[k[3]] += n * size(k[1])
        taken[k[3]] += got[k] * size(k[1])
        most[k[3]] = max(most[k[3]], n * size(k[1]))
    order = sorted(by, key=lambda s: (s is None, s or ""))
    want = fill(by, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 3)
    assert all(abs(taken[s] - want[s]) <= most[s] for s in by)


@pytest.fixture(scope="module")
def tokens():
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})

    def of(text):
        ids = enc.encode_ordinary(text or "")
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    return of


def test_encoding_stage(spark, tokens):
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in STAGES["bpe"](spark, odd(spark), SF).collect())
    assert got == Counter((k[0], *tokens(k[1])) for k, n in counted(odd(spark)).items() for _ in range(n))


def test_near_duplicates_of_null_and_shared_ids(spark, tmp_path):
    random.seed(9)
    word = lambda: "".join(random.choice("abcdefghijklm") for _ in range(5))
    a, b, c, d, e = ([word() for _ in range(150)] for _ in range(5))
    near = lambda t: " ".join([*t[:-1], word()])
    a2, b2 = near(a), near(b)
    a, b, c, d, e = map(" ".join, (a, b, c, d, e))
    rows = [(None, a), (None, a2), (None, c), (None, c), (7, b), (7, d), (7, d), (3, b2), (None, d), (5, e), (5, e), (None, None), (None, None), (8, None), (8, None)]
    df = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, df.repartition(5), str(tmp_path)).collect()), key=repr)
    one = [x for x in got if x[1] in (a, a2)]  # without ids, either of the near copies
    assert len(one) == 1 and one[0][0] is None
    got.remove(one[0])
    assert got == sorted([(None, c), (3, b2), (7, d), (5, e), (None, None), (None, None), (8, None)], key=repr)


def test_run_against_brute_force(spark, tokens):
    """The models are fitted by the operators; all that their decisions lead to is done by hand."""
    docs = docs_of(spark)
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = language_id.fit(docs.where(~held_out("doc_id")), language_id.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    said = language_id.predict(docs, model).collect()
    kept = {r["doc_id"] for r in said if r["lang_pred"] != "und" and r["score"] >= 0.5}
    left = docs.where(docs["doc_id"].isin(list(kept)))
    marks = toxicity.score(left, toxicity.fit(toxicity.labelled_rows(left, spark.read.parquet(f"{SF}/labels.parquet")))).collect()
    kept = {r["doc_id"] for r in marks if r["predicted"] == 0}
    root = classes([(i, rows[i]["text"]) for i in sorted(kept)])
    kept = sorted(i for i in kept if root[i] == i)
    size = {i: len([w for w in (rows[i]["text"] or "").replace("\x1c", "_").split(" ") for w in w.split("\n") for w in w.split("\t") if w.strip("\r\x0b\x0c")]) for i in kept}
    total = Counter()
    for i in kept:
        total[rows[i]["source"]] += size[i]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    want = fill(total, {s: (5, 2, 1)[j % 3] for j, s in enumerate(names)}, 3)
    expected = Counter()
    for s in names:
        whole = int(want[s] // total[s]) if total[s] else 0
        rest, start = want[s] - whole * total[s], 0
        for i in sorted((i for i in kept if rows[i]["source"] == s), key=lambda i: (hashlib.md5(f"7:{i}".encode()).hexdigest()[:8], i)):
            n = whole + (whole < 3 and start + size[i] / 2 <= rest)
            start += size[i]
            if n:
                expected[(i, *tokens(rows[i]["text"]))] += n
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == expected
