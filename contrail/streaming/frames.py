"""Frames out of packets of token text, with state by parts, expiry of idle connections and dead letters.

A connection's state is what its next packet needs, in parts that change apart: a small value (the unfinished token, the
time of the open frame and how many values it still lacks) and a list to which each packet's values of the open frame are
appended, so that a long frame is not written anew with every packet. A timer, moved by each packet, ends a connection that
has been idle. A token that is no number ends its connection: the packet's row names it, what the connection sends later is
named a dead letter too until it expires, and all other connections go on. State is kept by the session's state store, which
has to be the one on RocksDB (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROWS = "key string, kind string, sim_time double, vals array<float>, detail string"

#: Kinds of rows: a frame; a packet with a bad token; a packet of a connection that had one; a connection that was idle.
FRAME, BAD, DEAD, EXPIRED = "frame", "bad", "dead", "expired"


class Frames(StatefulProcessor):
    """One connection: tokens ``simTime N v0 ... v(N-1)``, again and again, cut into packets anywhere."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "rest string, sim_time double, missing int, ended boolean")
        self.vals = handle.getListState("vals", "vals array<double>")

    def _packet(self, text: str, state: list, have: list) -> Iterator[tuple[float, list]]:
        """Frames that a packet ends. ``state``: rest, time, missing values; ``have``: values of the open frame so far, those
        of earlier micro-batches as None, which stands for the list in the store."""
        text = state[0] + text
        tokens = text.split()
        state[0] = tokens.pop() if tokens and not text[-1].isspace() else ""
        for token in tokens:
            if state[1] is None:
                state[1] = float(token)
            elif state[2] is None:
                state[2] = max(0, int(float(token)))
            else:
                have.append(float(token))
                state[2] -= 1
            if state[2] == 0:
                yield state[1], list(have)
                state[1], state[2] = None, None
                have.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rest, at, missing, ended = self.open.get() if self.open.exists() else ("", None, None, False)
        state, have, out = [rest, at, missing], [None], []
        for text in pd.concat(list(rows)).sort_values("at", kind="stable")["data"].fillna(""):
            if ended:
                out.append((key[0], DEAD, None, None, text))
                continue
            try:
                for t, vals in self._packet(text, state, have):
                    if vals and vals[0] is None:
                        vals = [v for (part,) in self.vals.get() for v in part] + vals[1:]
                        self.vals.clear()
                    out.append((key[0], FRAME, t, vals, None))
            except (ValueError, OverflowError) as e:
                out.append((key[0], BAD, None, None, str(e)))
                ended, state = True, ["", None, None]
                self.vals.clear()
                have.clear()
        if new := [v for v in have if v is not None]:
            self.vals.appendValue((new,))
        self.open.update((*state, ended))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=["key", "kind", "sim_time", "vals", "detail"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rest, at, missing, ended = self.open.get() if self.open.exists() else ("", None, None, False)
        what = "ended" if ended else f"an open frame lacks {missing} values" if missing else "between frames"
        self.open.clear()
        self.vals.clear()
        yield pd.DataFrame([(key[0], EXPIRED, at, None, what)], columns=["key", "kind", "sim_time", "vals", "detail"])

    def close(self) -> None:
        pass


def frames(packets: DataFrame, key: str = "conn", order: str = "packet", data: str = "data", idle_seconds: float = 60.0) -> DataFrame:
    """``key, kind, sim_time, vals, detail`` of a stream of packets (see :class:`Frames`): frames, dead letters, expiries.

    Rows of a connection in a micro-batch, which the trigger bounds, are taken in order of arrival. A null packet is empty,
    a null key a connection of its own. Timers ask for batches without data again and again: a run of what is available ends
    only if ``spark.sql.streaming.noDataMicroBatches.enabled`` is off, and expires nothing then.
    """
    x = packets.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(order).cast("long").alias("at"), F.col(data).cast("string").alias("data"))
    return x.groupBy("key").transformWithStateInPandas(Frames(int(idle_seconds * 1000)), ROWS, "Append", "ProcessingTime")
