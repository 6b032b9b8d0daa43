"""Faults, cheapest edits and digests of conversations against exhaustive search; blocks against whole conversations."""

import hashlib
import random
import re
from contextlib import contextmanager

from pyspark.sql import functions as F

from contrail.llm import conversation_repair as cr
from contrail.llm.queries import op13_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string, gone boolean, seq string, cost string, key int"
WHITE = " \t\n\x0b\x0c\r"
COST = {"K": 0, "R": 1, "D": 2, "I": 5}


def ordered(rows):
    """Rows (turn, role, text), nulls as one space, in the order of a conversation."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.rstrip(WHITE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def every_edit(rows, fault, most):
    """All (cost, audit, left rows) of at most some cost, from the definition alone."""
    def go(i, cost, audit, left):
        if cost > most:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in left)):
            yield cost, audit, left
        for role in ("user", "assistant"):
            yield from go(i, cost + 5, audit + "I", [*left, (role, "")])
        if i < len(rows):
            _, role, text = rows[i]
            yield from go(i + 1, cost + 2, audit + "D", left)
            if fault[i] not in ("blank", "duplicate"):
                more = 5 * (fault[i] == "truncated")
                yield from go(i + 1, cost + more, audit + "K", [*left, (role, text)])
                for new in ("user", "assistant"):
                    yield from go(i + 1, cost + 1 + more, audit + "R", [*left, (new, text)])

    yield from go(0, 0, "", [])


def digest(left):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()


def told(rows):
    rows = ordered(rows)
    f = faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return rows, f, (gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal)


def plain(rows):
    rows, f, counts = told(rows)
    cost, audit, left = min(every_edit(rows, f, 2 * len(rows)), key=lambda x: x[:2])
    return (*counts, cost, audit, digest(left))


def by_search(rows):
    """The search over the whole conversation, however long."""
    rows, f, counts = told(rows)
    [(_, (cost, audit))] = cr.cheapest([(r[:1], x in ("blank", "duplicate"), x == "truncated") for (_, r, _), x in zip(rows, f, strict=True)]).items()
    return (*counts, cost, audit, digest([(r, t) for _, r, t in cr.applied([(r, t) for _, r, t in rows], audit)]))


@contextmanager
def many_tasks(spark, parts):
    """Small partitions stay apart."""
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def got(spark, convs, parts=5, **options):
    data = [(c, *r, False, "x", "y", 1) for c, rows in convs.items() for r in rows] + [(c, 5, "user", "not there.", True, "x", "y", 1) for c in convs]
    random.shuffle(data)
    df = spark.createDataFrame(data, SCHEMA) if data else spark.createDataFrame([], SCHEMA)
    with many_tasks(spark, parts):
        out = cr.repair(df, gone=F.col("gone"), **options).collect()
    assert len(out) == len(convs)
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in out}


def conversation(n, turns=None):
    texts = ["One.", "Two!", "cut off", " ", "", "Three? \n", "é."]
    return [((turns or random.randint)(0, 6) if random.random() < 0.9 else None, random.choice(["user", "assistant", "system", "tool", "", None, "upper"]), random.choice([*texts, None])) for _ in range(n)]


def test_exhaustive(spark):
    random.seed(21)
    convs = {i: conversation(random.randint(0, 5)) for i in range(40)} | {None: conversation(4)}
    want = {c: plain(rows) for c, rows in convs.items()}
    assert want == {c: by_search(rows) for c, rows in convs.items()}
    assert got(spark, convs) == want
    assert got(spark, convs, block=2) == want  # cut into blocks
    assert got(spark, {}) == {}


def test_one_long_conversation_over_many_tasks(spark):
    """A conversation with most rows lies in many partitions and blocks; its edits, counts and digest are those of one search."""
    random.seed(22)
    convs = {7: [(t, random.choice(["user", "assistant", "system"]), random.choice([f"say {t}.", f"ask {t}?", "again.", "cut", " "])) for t in range(0, 2400, 2)], 3: conversation(6), 9: conversation(7)}
    want = {c: by_search(rows) for c, rows in convs.items()}
    out = got(spark, convs, parts=9, block=16)
    assert out == want and want[7][5] > 500
    data = spark.createDataFrame([(c, *r, False, "", "", 1) for c, rows in convs.items() for r in rows], SCHEMA)
    with many_tasks(spark, 9):
        cut = cr.blocks(data, block=16)
    assert cut.where("conv = 7").selectExpr("seq >> 32 as part").distinct().count() > 2


def test_copies_are_counted_not_carried(spark):
    """Equal rows of one turn come as one row and a number."""
    row = (1, "user", "Same.")
    convs = {1: [row] * 3000 + [(2, "assistant", "Reply.")], 2: [row] * 5}
    out = got(spark, convs)
    assert out[1] == by_search(convs[1]) and out[1][2] == 2999 and out[2] == plain(convs[2])
    x = cr.prepared(spark.createDataFrame([(1, *row)] * 3000, "conv_id long, turn long, role string, text string"), "conv_id", "turn", "role", "text", None)
    assert [(r["copies"], r["fresh"]) for r in x.collect()] == [(3000, True)]


def test_repaired_rows(spark):
    convs = {1: [(0, "system", "Be kind."), (1, "assistant", "Hello."), (3, "user", "And?")], 2: []}
    df = spark.createDataFrame([(c, *r) for c, rows in convs.items() for r in rows], "conv_id long, turn long, role string, text string")
    cut = cr.blocks(df)
    rows = cr.repaired_rows(cut, cr.decisions(cut)).orderBy("conv", "seq", "place").collect()
    [(cost, audit, left)] = [min(every_edit(ordered(convs[1]), ["", "", ""], 6), key=lambda x: x[:2])]
    assert [(r["role"], r["text"]) for r in rows] == left and "".join(r["edit"] for r in rows) == audit.replace("D", "") and cost == 2


def test_query_keeps_every_conversation(spark):
    sf = "/root/testdata/sf0.001"
    want = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count()
    assert op13_conversation_repair(spark, sf).select("conv_id").distinct().count() == want
