"""Frames of the control link: token text and length-prefixed binary messages."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

#: The reply's tags and how many floats a status carries.
STATUS, RESET, ACTION_SIZE = b"STATUS", b"RESET", 640


def token_frame(line: Column) -> Column:
    """``sim_time, vals`` of ``simTime N v0 ... v(N-1)``; null if tokens are missing or no numbers."""
    tokens = F.split(F.regexp_replace(F.trim(line), r"\s+", " "), " ")
    numbers = F.transform(tokens, lambda t: t.try_cast("double"))
    n = F.get(numbers, F.lit(1)).cast("int")
    vals = F.slice(numbers, 3, F.greatest(n, F.lit(0))).cast("array<float>")
    whole = (F.size(vals) == n) & F.forall(F.slice(numbers, 1, n + 2), lambda v: v.isNotNull())
    return F.when((F.size(tokens) >= 2) & (n >= 0), F.when(whole, F.struct(F.get(numbers, F.lit(0)).alias("sim_time"), vals.alias("vals"))))


def binary_messages(files: DataFrame, content: str = "content", key: str = "path") -> DataFrame:
    """``key, pos, vals, error`` of files of messages: a little-endian length, then that many bytes of float32.

    A length of 0 is an empty message, one that is no multiple of 4 an error; a message that the file cuts off ends it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, data in zip(b["key"], b["content"], strict=True):
                rows, at, pos = [], 0, 0
                while data is not None and at + 4 <= len(data):
                    (n,) = struct.unpack_from("<I", data, at)
                    if at + 4 + n > len(data):
                        break
                    odd = n % 4 != 0
                    rows.append((k, pos, None if odd else np.frombuffer(data, "<f4", n // 4, at + 4), "length is no multiple of 4" if odd else None))
                    at, pos = at + 4 + n, pos + 1
                    if len(rows) == 4096:
                        yield pd.DataFrame(rows, columns=["key", "pos", "vals", "error"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["key", "pos", "vals", "error"])

    return files.select(F.col(key).cast("string").alias("key"), F.col(content).alias("content")).mapInPandas(run, "key string, pos long, vals array<float>, error string")


@F.pandas_udf(BinaryType())
def packed(vals: pd.Series) -> pd.Series:
    """A length-prefixed message of float32."""
    return vals.map(lambda v: None if v is None else struct.pack("<I", 4 * len(v)) + np.asarray(v, "<f4").tobytes())


@F.pandas_udf(BinaryType())
def reply(message: pd.Series, action: pd.Series) -> pd.Series:
    """``STATUS`` and the action's 640 floats, or ``RESET``; an action of another size is an error."""

    def one(m, a):
        if m == "RESET":
            return RESET
        if len(a) != ACTION_SIZE:
            raise ValueError(f"an action has {ACTION_SIZE} numbers, not {len(a)}")
        return STATUS + np.asarray(a, "<f4").tobytes()

    return pd.Series([one(m, a) for m, a in zip(message, action, strict=True)])


def halved(messages: DataFrame) -> DataFrame:
    """``messages`` of :func:`binary_messages`, of a table or a stream, with ``reply``: the message of each one's numbers
    halved; null for an error."""
    return messages.withColumn("reply", packed(F.transform("vals", lambda v: (v * 0.5).cast("float"))))
