"""Size-checked broadcast.

A side is broadcast only after it has been measured: at most ``max_rows``
rows and at most ``max_bytes`` of data (the text width of its values, a
close proxy for what the broadcast hash table holds). The measure is one
global aggregate: each task counts its own split and only one partial row
per task crosses the shuffle, so no task ever holds more than its split, even
when the side turns out to be huge. (A ``limit`` would stop scans early but
funnels up to ``max_rows`` rows per partition into a single task.) A side
over either bound is left to a shuffle join, where AQE can still split a
skewed partition.

``max_rows=None`` skips the check (no job at plan-building time) and adds no
hint: the join strategy is then Spark's, from its size estimate and AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A plant -> subsystem row is two short strings. Within these bounds the hash
# table built on each executor stays in the tens of MB.
DEFAULT_BROADCAST_MAX_ROWS = 500_000
DEFAULT_BROADCAST_MAX_BYTES = 32 * 1024 * 1024


def _text_width(df: DataFrame):
    return sum((F.coalesce(F.octet_length(df[c].cast("string")), F.lit(0)) for c in df.columns),
               F.lit(0))


def size_measures(df: DataFrame) -> list:
    """The aggregates that measure a side: rows ``n`` and bytes ``b``."""
    return [F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum(_text_width(df)), F.lit(0)).cast("bigint").alias("b")]


def fits_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_MAX_ROWS,
                   max_bytes: int = DEFAULT_BROADCAST_MAX_BYTES,
                   size: tuple[int, int] | None = None) -> bool:
    """Whether ``df`` is within both bounds. ``size`` (rows, bytes) spares the
    job that measures it."""
    if max_rows <= 0 or max_bytes <= 0:
        return False
    if size is None:
        size = tuple(df.agg(*size_measures(df)).collect()[0])
    return size[0] <= max_rows and size[1] <= max_bytes


def bounded_broadcast(df: DataFrame, max_rows: int | None = DEFAULT_BROADCAST_MAX_ROWS,
                      max_bytes: int = DEFAULT_BROADCAST_MAX_BYTES,
                      size: tuple[int, int] | None = None) -> tuple[DataFrame, bool]:
    """``(broadcast(df), True)`` if ``df`` is within both bounds, else
    ``(df, False)``; ``(df, True)`` unchecked and unhinted when ``max_rows``
    is None. Without ``size`` the check is a job, run while the plan is built."""
    if max_rows is None:
        return df, True
    if fits_broadcast(df, max_rows, max_bytes, size):
        return F.broadcast(df), True
    return df, False
