"""Text of a state frame's first platforms. Numbers are written as Python writes them, hence by an Arrow-batched function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The platforms that a frame's text has, in order, and the fields of each.
PLATFORMS = ("red_1", "red_2", "blue_1", "blue_2")
FIELDS = ("live", "lat", "lon", "alt_m", "velN_mps", "velE_mps", "velD_mps", "heading_deg")


def frame_text(sim_time: float, vals) -> str:
    """One frame: a line for its time and one for each platform; a notice if it is too short or has no whole number for
    a platform's ``live``."""
    n = None if vals is None else len(vals)
    if n is None or n < len(PLATFORMS) * len(FIELDS):
        return f"T={sim_time:.2f} (state too short: {n})"
    lines = [f"T={sim_time:.2f}"]
    for i, name in enumerate(PLATFORMS):
        live, *rest = (float(v) for v in vals[i * len(FIELDS) : (i + 1) * len(FIELDS)])
        try:
            numbers = [int(live), *rest]
        except (ValueError, OverflowError) as e:
            return f"Data Error: {e}"
        lines.append(f"{name}: {dict(zip(FIELDS, numbers, strict=True))}")
    return "\n".join(lines) + "\n"


@F.pandas_udf(StringType())
def context_text(sim_time: pd.Series, vals: pd.Series) -> pd.Series:
    """:func:`frame_text` of each row; null for a null time."""
    return pd.Series([None if pd.isna(t) else frame_text(t, v) for t, v in zip(sim_time, vals, strict=True)], dtype=object)
