"""The positional index and its phrase and proximity searches against brute force."""

import random
import re

from contrail.llm import decontamination as dc

DOCS = "doc_id long, text string, id string, block long, items string, spans int"
ITEMS = "item_id long, text string, terms string, n_words int"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def matches(w, p, slop):
    """Where all words of p are within slop of their places."""
    for s in range(-slop, len(w) - len(p) + slop + 1):
        if all(any(w[q] == x for q in range(max(0, s + j - slop), min(len(w), s + j + slop + 1))) for j, x in enumerate(p)):
            yield s


def plain(docs, items, size, slop):
    wanted = {(i, tuple(w[k : k + min(size, len(w))])) for i, t in items for w in [words(t)] if w for k in range(len(w) - min(size, len(w)) + 1)}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, p in wanted:
            for s in matches(w, p, slop):
                hit |= set(range(max(s, 0), min(s + len(p), len(w))))
                found.add(i)
        out.append((d, len(w), len(hit), sorted(found - {None})))
    return sorted(out, key=repr)


def check(spark, docs, items, size=10, slop=0, **options):
    d = spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, "x", 1) for i, t in items], ITEMS)
    got = dc.contamination(d, b, size=size, slop=slop, **options).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], sorted(r["items"])) for r in got), key=repr)
    assert got == plain(docs, items, size, slop)
    return got


ODD = [(1, None), (2, ""), (3, "..!?"), (None, "The quick brown fox"), (None, "the QUICK, brown fox."), (4, "Ünï cödé\x00ÄÖ ünï CÖDÉ 北京 北京\x80x"), (4, "a-b_c`d{e"), (5, "fox " * 5000)]
TESTS = [(1, "quick brown"), (1, "fox fox fox"), (2, "Quick BROWN"), (None, "brown fox"), (3, None), (4, ""), (5, "Ünï cödé"), (6, "北京\x80x"), (7, "b c d"), (8, "x y z")]


def test_odd_rows(spark):
    got = check(spark, ODD, TESTS)
    assert (None, 4, 3, [1, 2]) in got and (5, 5000, 5000, [1]) in got
    check(spark, ODD, [])
    check(spark, [], TESTS)
    check(spark, ODD, TESTS, part=1)
    check(spark, ODD, TESTS, block_bytes=1)


def random_texts(n, length, letters="abcd"):
    return [(i, " ".join(random.choice(letters) for _ in range(random.randint(0, length)))) for i in range(n)]


def test_exact_windows(spark):
    random.seed(11)
    docs = random_texts(60, 60)
    items = random_texts(12, 14)
    check(spark, docs, items, size=4)
    check(spark, docs, items, size=4, part=20)  # several passes give the same spans and items
    check(spark, docs, items, size=6, block_bytes=200)


def test_proximity(spark):
    random.seed(12)
    docs = random_texts(40, 25, "abcdefgh")
    items = random_texts(10, 9, "abcdefgh")
    for slop in (1, 2):
        a = check(spark, docs, items, size=5, slop=slop)
        assert a == check(spark, docs, items, size=5, slop=slop, block_bytes=100)
    assert sum(r[2] for r in a) > sum(r[2] for r in check(spark, docs, items, size=5))


def test_a_passage_in_a_third_of_all(spark):
    random.seed(13)
    passage = " ".join(f"p{i}" for i in range(30))
    docs = [(i, f"{random.random()} {passage} end" if i % 3 == 0 else f"word{i} other text of its own") for i in range(600)]
    got = check(spark, docs, [(1, passage), (2, passage + " more"), (3, "nothing of it")])
    assert sum(r[3] == [1, 2] for r in got) == 200


def test_short_candidate_parts(spark, monkeypatch):
    monkeypatch.setattr(dc, "_CANDIDATES", 3)
    random.seed(14)
    row = {"ids": list(range(20))}
    w = dc.Words()
    hashes, firsts = w.of([t.encode() for _, t in random_texts(20, 30, "ab")])
    terms, counts, steps = dc._posted(hashes, firsts)
    block = dc.Block(row | {"firsts": dc._shuffled(firsts), "terms": terms.tobytes(), "counts": dc._shuffled(counts), "postings": dc._shuffled(steps)})
    p, _ = w.of([b"a b a"])
    _, doc, start = block.search(p.reshape(1, -1))
    begin = [int(x) for x in block.doc_begin]
    text = [[hashes[k] for k in range(firsts[d], firsts[d + 1])] for d in range(20)]
    want = {(d, begin[d] + s) for d in range(20) for s in range(len(text[d]) - 2) if text[d][s : s + 3] == list(p)}
    assert set(zip(doc.tolist(), start.tolist(), strict=True)) == want


def test_words_of_joined_texts_do_not_run_together():
    w = dc.Words()
    h, firsts = w.of([b"ab", b"cd ab", b"", b"AB"])
    assert firsts.tolist() == [0, 1, 3, 3, 4] and h[0] == h[2] == h[3] != h[1]
