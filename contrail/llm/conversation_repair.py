"""Conversation structure repair: the cheapest edits that make the roles of a conversation follow a grammar.

Rows of a conversation in order of their turns (nulls first; rows of one turn by a digest) have at most one fault each:
``blank`` (no character but ASCII white space), ``duplicate`` (role and text seen earlier in it) or ``truncated`` (its last
such character is none of ``.!?``). Edits are Keep (cost 0), Rerole to user or assistant (1), Delete (2; required for blank
and duplicate rows) and Insert of an empty user or assistant row anywhere (5); a truncated row that stays adds 5. The role
initials left have to be ``(s?(ua)+)?``, so from each of the grammar's four states there is one role that Rerole and Insert
can give, and a string of edits names one path.

The edits are found by Dijkstra on the lattice of (rows consumed, grammar state), which is never built: the queue's key is
(cost, audit), the audit being the edits' initials so far, and the first accepting end node that is taken from the queue is
the cheapest repair and of equal ones the ASCII-least.

Rows are dealt out by ranges of (conversation, turn), so one long conversation lies in many tasks, and a task cuts what it
reads into blocks of at most ``block`` rows. A conversation that is inside one task and block is solved at once. Of a block of
any other, the same search gives for each state it may be entered in the best (cost, audit) of each state it may be left
in. Two such paths of equal cost never have audits of which one begins the other (the longer would hold more inserts, so
cost more), hence the best of all is made of best parts: these tables, not texts, are put together in the order of a
conversation's blocks. Texts meet the decisions by block again; a conversation's digest is the only step that reads its
texts one after the other, as a hash has to, and it holds one block at a time.

Defined cases: a null role or text is one space; a null conversation id is a conversation like any other; a null turn comes
first and counts for no gap; of equal rows of one turn all but one are duplicates; a conversation whose rows are all
``gone`` has zeros, no edits and the digest of an empty text; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from contrail.llm.common import stored

#: ASCII white space; what a Rerole or Insert costs, a Delete, an Insert, and a truncated row that stays.
SPACE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: The grammar: before any row, after the system's, after a user's, after an assistant's. Of each state the role that may be
#: given and where it leads, and where the initials of kept rows lead.
GIVEN = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTING = (0, 3)

_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_WIDE = "rows array<struct<role:string,text:string>>, costs array<long>, audits array<string>"
_STATS = "n long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, first_turn long, last_turn long, turns long"


def cheapest(rows: list[tuple[str, bool, bool]], entry: int = 0, ends: tuple[int, ...] = ACCEPTING, all_ends: bool = False) -> dict[int, tuple[int, str]]:
    """(cost, audit) of the best edits of ``rows`` (initial, must go, truncated) from state ``entry`` to the first of ``ends``
    that is reached, or to each of them."""
    queue, done, found = [(0, "", 0, entry)], set(), {}
    while queue:
        cost, audit, i, state = heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ends:
            found[state] = (cost, audit)
            if not all_ends or len(found) == len(ends):
                break
        to = GIVEN[state][1]
        if (i, to) not in done:
            heappush(queue, (cost + INSERT, audit + "I", i, to))
        if i < len(rows):
            initial, must_go, truncated = rows[i]
            heappush(queue, (cost + DELETE, audit + "D", i + 1, state))
            if not must_go:
                stays = cost + TRUNCATED * truncated
                heappush(queue, (stays + REROLE, audit + "R", i + 1, to))
                if (kept := KEPT[state].get(initial)) is not None:
                    heappush(queue, (stays, audit + "K", i + 1, kept))
    return found


def applied(rows: list[tuple[str, str]], audit: str, state: int = 0) -> Iterator[tuple[str, str, str]]:
    """The rows (edit, role, text) that the edits leave."""
    at = iter(rows)
    for edit in audit:
        role, text = next(at) if edit != "I" else ("", "")
        if edit == "D":
            continue
        if edit == "K":
            state = KEPT[state][role[:1]]
        else:
            role, state = GIVEN[state]
        yield edit, role, text


def _mapped(df: DataFrame, rows, schema: str, size: int = 256) -> DataFrame:
    """``rows(batches)`` of each partition, dicts of ``schema``, in batches of some hundred or some megabytes of text."""
    kind = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(lambda batches: _batches(rows(batches), kind, size), schema)


def _batches(rows: Iterator[dict], kind: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for r in rows:
        held.append(r)
        weight += 1 + sum(len(x["text"]) for x in r.get("rows") or ()) // 16384
        if weight >= size:
            yield pa.RecordBatch.from_pylist(held, kind)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, kind)


def prepared(rows: DataFrame, conv: str, turn: str, role: str, text: str, gone: Column | None) -> DataFrame:
    """One row for each distinct (conversation, turn, role, text) with its faults: ``key, conv, dated, turn, digest, role,
    text, gone, copies, fresh, blank, truncated``; ``fresh`` if its role and text are not in an earlier turn."""
    away = F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False)
    c = F.col(conv).cast("string")
    said = lambda name: F.when(away, "").otherwise(F.coalesce(F.col(name).cast("string"), F.lit(" ")))
    x = rows.select(
        F.when(c.isNull(), "").otherwise(F.concat(F.lit("="), c)).alias("key"),
        F.col(conv).alias("conv"),
        (F.col(turn).isNotNull() & ~away).alias("dated"),
        F.when(away, 0).otherwise(F.coalesce(F.col(turn).cast("long"), F.lit(0))).alias("turn"),
        said(role).alias("role"),
        said(text).alias("text"),
        away.alias("gone"),
    )
    x = x.withColumn("digest", F.when(F.col("gone"), "").otherwise(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    once = x.groupBy("key", "dated", "turn", "digest").agg(F.count(F.lit(1)).alias("copies"), *[F.first(k).alias(k) for k in ("conv", "role", "text", "gone")])
    # equal texts of a conversation meet as small rows; the join's key is a row's own, so it has no hot one
    first = x.select("key", "digest", F.struct("dated", "turn").alias("at")).groupBy("key", "digest").agg(F.min("at").alias("at")).select("key", "at.dated", "at.turn", "digest", F.lit(True).alias("fresh"))
    y = once.join(first, ["key", "dated", "turn", "digest"], "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))
    end = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    return y.withColumn("blank", end == "").withColumn("truncated", ~end.isin(".", "!", "?"))


class _Block:
    """Rows of one conversation and their counts."""

    def __init__(self):
        self.codes, self.rows, self.counts = [], [], dict.fromkeys(_COUNTS, 0)
        self.first_turn = self.last_turn = None
        self.turns = 0

    def add(self, r: dict, copy: int) -> None:
        fault = "blank" if r["blank"] else "duplicate" if copy or not r["fresh"] else "truncated" if r["truncated"] else None
        if fault:
            self.counts[fault] += 1
        initial = r["role"][:1]
        if self.codes and self.codes[-1][0] + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.codes.append((initial, fault in ("blank", "duplicate"), fault == "truncated"))
        self.rows.append((r["role"], r["text"]))
        if r["dated"] and self.last_turn != r["turn"]:
            self.turns, self.last_turn = self.turns + 1, r["turn"]
            if self.first_turn is None:
                self.first_turn = r["turn"]

    def told(self) -> dict:
        ends = {"first_initial": self.codes[0][0], "last_initial": self.codes[-1][0]} if self.codes else {"first_initial": None, "last_initial": None}
        return self.counts | ends | {"n": len(self.codes), "first_turn": self.first_turn, "last_turn": self.last_turn, "turns": self.turns}

    def solved(self, whole: bool) -> dict:
        """Costs and audits by entry and exit: of the first search alone if the block is a whole conversation."""
        costs, audits = [None] * 16, [None] * 16
        for entry in range(1 if whole else 4):
            for out, (cost, audit) in cheapest(self.codes, entry, ACCEPTING if whole else (0, 1, 2, 3), not whole).items():
                costs[4 * entry + out], audits[4 * entry + out] = cost, audit
        return {"costs": costs, "audits": audits, "rows": [{"role": a, "text": t} for a, t in self.rows]}


def blocks(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: Column | None = None, block: int = 256) -> DataFrame:
    """Blocks of conversations with their rows, counts and tables of edits; a stored table. ``seq`` orders the blocks of a
    conversation, ``whole`` says that there is no other. ``gone``: rows that only say that their conversation exists."""
    x = prepared(rows, conv, turn, role, text, gone)
    order = ("key", "dated", "turn", "digest")
    x = x.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = f"key string, conv {rows.schema[conv].dataType.simpleString()}, seq long, whole boolean, {_STATS}, {_WIDE}"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        key, now, held, started, earlier = None, None, None, False, 0  # earlier: conversations, then blocks of this one
        b = _Block()

        def out(whole: bool) -> dict:
            return {"key": key, "conv": now, "seq": number, "whole": whole} | b.told() | b.solved(whole)

        for batch in batches:
            for r in batch.to_pylist():
                if r["key"] != key:
                    if started:
                        yield out(whole=earlier > 0 and not held)
                        number, earlier, b = number + 1, earlier + 1, _Block()
                    key, now, held, started = r["key"], r["conv"], False, True
                for copy in range(0 if r["gone"] else r["copies"]):
                    if len(b.codes) == block:
                        yield out(whole=False)
                        number, held, b = number + 1, True, _Block()
                    b.add(r, copy)
        if started:
            yield out(whole=False)

    return stored(_mapped(x, cut, schema))


def _decided(rows: Iterator[dict]) -> Iterator[dict]:
    """Entry and exit of each block of conversations that come block by block; with the last one, what holds for all."""

    def closed(key: str, steps: list, alive: dict, said: list, total: dict) -> Iterator[dict]:
        state = min(((alive[s][0], alive[s][1], s) for s in ACCEPTING if s in alive))[2]
        cost, audit = alive[state][0], "".join(said) + alive[state][1]
        entries = []
        for _, came in reversed(steps):
            entries.append((came[state], state))
            state = came[state]
        for (seq, _), (entry, exit_) in zip(steps, reversed(entries), strict=True):
            last = seq == steps[-1][0]
            yield {"seq": seq, "entry": entry, "exit": exit_, "key": key} | ({"cost": cost, "audit": audit, "totals": total} if last else {})

    key, steps = None, []
    for r in rows:
        if r["key"] != key:
            if steps:
                yield from closed(key, steps, alive, said, total)
            key, steps, said, alive = r["key"], [], [], {0: (0, "")}
            total = dict.fromkeys((*_COUNTS, "turns"), 0) | {"first_turn": None, "last_turn": None}
            last_initial = None
        best, came = {}, {}
        for entry, (cost, audit) in alive.items():
            for out in range(4):
                more = r["costs"][4 * entry + out]
                if more is not None and (out not in best or (cost + more, audit + r["audits"][4 * entry + out]) < best[out]):
                    best[out], came[out] = (cost + more, audit + r["audits"][4 * entry + out]), entry
        # what all paths begin with is settled: only their tails are compared from then on
        same = commonprefix([a for _, a in best.values()])
        said.append(same)
        alive = {s: (c, a[len(same) :]) for s, (c, a) in best.items()}
        steps.append((r["seq"], came))
        for c in _COUNTS:
            total[c] += r[c]
        if r["n"]:
            if last_initial is not None and last_initial + r["first_initial"] not in ("su", "ua", "au"):
                total["illegal"] += 1
            last_initial = r["last_initial"]
        if r["turns"]:
            total["turns"] += r["turns"] - (total["last_turn"] == r["first_turn"])
            total["last_turn"] = r["last_turn"]
            total["first_turn"] = r["first_turn"] if total["first_turn"] is None else total["first_turn"]
    if steps:
        yield from closed(key, steps, alive, said, total)


_TOTALS = "struct<blank:long,duplicate:long,truncated:long,illegal:long,turns:long,first_turn:long,last_turn:long>"
_DECIDED = f"seq long, entry int, exit int, key string, cost long, audit string, totals {_TOTALS}"


def decisions(cut: DataFrame) -> DataFrame:
    """``seq, entry, exit, key, cost, audit, totals`` of each block; a stored table. The last three are with a conversation's
    last block."""
    own = (F.col("costs")[0].isNull()) | (F.col("costs")[3] < F.col("costs")[0]) | ((F.col("costs")[3] == F.col("costs")[0]) & (F.col("audits")[3] < F.col("audits")[0]))
    out = F.when(own, 3).otherwise(0)
    totals = F.struct(*_COUNTS, "turns", "first_turn", "last_turn")
    whole = cut.where("whole").select("seq", F.lit(0).alias("entry"), out.alias("exit"), "key", F.get("costs", out).alias("cost"), F.get("audits", out).alias("audit"), totals.alias("totals"))
    rest = cut.where("not whole").drop("rows", "conv", "whole").repartition("key").sortWithinPartitions("key", "seq")

    return stored(whole.union(_mapped(rest, lambda batches: _decided(r for b in batches for r in b.to_pylist()), _DECIDED, 4096)))


def repaired_rows(cut: DataFrame, decided: DataFrame) -> DataFrame:
    """``conv, key, seq, place, edit, role, text``: the rows of repaired conversations, by block and place in it."""
    kind = cut.schema["conv"].dataType.simpleString()
    schema = f"key string, conv {kind}, seq long, place int, edit string, role string, text string"
    x = cut.select("key", "conv", "seq", "rows", "audits").join(decided.select("seq", "entry", "exit"), "seq")
    x = x.select("key", "conv", "seq", "rows", "entry", F.get("audits", F.col("entry") * 4 + F.col("exit")).alias("audit"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for r in b.to_pylist():
                for i, (edit, role, text) in enumerate(applied([(a["role"], a["text"]) for a in r["rows"]], r["audit"], r["entry"])):
                    yield {"key": r["key"], "conv": r["conv"], "seq": r["seq"], "place": i, "edit": edit, "role": role, "text": text}

    return _mapped(x, rows, schema)


def _digests(cut: DataFrame, decided: DataFrame) -> DataFrame:
    """``key, repaired_sha256`` of each conversation: the hash of its repaired rows, streamed in their order."""
    x = cut.select("key", "seq", "whole", "rows", "audits").join(decided.select("seq", "entry", "exit"), "seq")
    x = x.select("key", "seq", "whole", "rows", "entry", F.get("audits", F.col("entry") * 4 + F.col("exit")).alias("audit"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        key, h, some = None, None, False
        for b in batches:
            for r in b.to_pylist():
                if r["key"] != key:
                    if h:
                        yield {"key": key, "repaired_sha256": h.hexdigest()}
                    key, h, some = r["key"], hashlib.sha256(), False
                for _, role, text in applied([(a["role"], a["text"]) for a in r["rows"]], r["audit"], r["entry"]):
                    h.update(f"{chr(10) if some else ''}{role}:{text}".encode())
                    some = True
        if h:
            yield {"key": key, "repaired_sha256": h.hexdigest()}

    schema = "key string, repaired_sha256 string"
    alone = _mapped(x.where("whole"), each, schema, 4096)
    rest = x.where("not whole").repartition("key").sortWithinPartitions("key", "seq")
    return alone.union(_mapped(rest, each, schema, 4096))


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: Column | None = None, block: int = 256) -> DataFrame:
    """``conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``: a row for each conversation.

    ``gaps``: turns missing between the first and the last; ``blank, duplicate, truncated``: rows by their first fault;
    ``illegal``: neighbours whose role initials are not su, ua or au; ``audit``: the edits' initials in order;
    ``repaired_sha256``: of ``role:text`` of the rows left, joined by newlines. For the rows themselves see ``repaired_rows``.
    """
    cut = blocks(rows, conv, turn, role, text, gone, block)
    decided = decisions(cut)
    gaps = F.when(F.col("totals.turns") > 0, F.col("totals.last_turn") - F.col("totals.first_turn") + 1 - F.col("totals.turns")).otherwise(0)
    done = decided.where("totals is not null").select("key", "seq", gaps.cast("long").alias("gaps"), *[F.col(f"totals.{c}").alias(c) for c in _COUNTS], "cost", "audit")
    named = done.join(cut.select("seq", "conv"), "seq").join(_digests(cut, decided), "key")
    return named.select(F.col("conv").alias(conv), "gaps", *_COUNTS, "cost", "audit", "repaired_sha256")
