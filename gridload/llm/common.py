"""Small helpers shared by the operators: columns, Arrow text buffers, tables
written to the shared folder to cut lineage.

An operator selects the columns it needs first, so columns of the input with
other names, also names the operator uses for its own output, do not matter.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import threading
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

# Fixed value: the separator bytes of [^\x20\x09-\x0D]+ words.
WORD = "[^\\x20\\x09-\\x0D]+"


BATCH_BYTES = 8 << 20

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Lets Python workers on machines that have this folder import the package,
    also when the driver found it through ``sys.path``. (Elsewhere, ship it with
    ``--py-files``.)"""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    bound_batches(spark)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES`` (or one row) in this session, so
    that what a Python worker holds does not grow with the length of rows. A
    smaller bound that the caller has set stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(re.match(r"\d+", spark.conf.get(key)).group())
    if now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (a null id counts as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


class _Scopes(threading.local):
    """Tables of the blocks that this thread is in, the innermost last."""

    def __init__(self):
        self.open: list[list[str]] = []


_SCOPES = _Scopes()


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read back: later
    steps start from the files, whatever executors are lost. Within
    :func:`intermediates` the files go when the block ends; with ``keep`` they
    stay as long as the block around it (or for good)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if len(_SCOPES.open) > keep:
        _SCOPES.open[-1 - keep].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def intermediates(spark: SparkSession):
    """Deletes what :func:`written` wrote in the block when it ends: what leaves
    the block must not read those tables any more."""
    _SCOPES.open.append([])
    try:
        yield
    finally:
        jvm = spark._jvm
        conf = spark._jsc.hadoopConfiguration()
        for path in _SCOPES.open.pop():
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


_KEPT: dict[str, Callable[[], None]] = {}
_LAST: list[str] = []


def keep(owner: str, clear: Callable[[], None]) -> None:
    """Names how to clear what ``owner`` keeps in a Python worker between tasks."""
    _KEPT[owner] = clear


def release_others(owner: str) -> None:
    """Clears what other operators keep in this worker: Spark uses a worker for
    the tasks of one stage after another, and the memory of all would add up. What
    the allocators hold on to goes back as well when the operator changes."""
    for name in [n for n in _KEPT if n != owner]:
        _KEPT.pop(name)()
    if _LAST != [owner]:
        _LAST[:] = [owner]
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's only
        if trim:
            trim(0)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string (or binary) column, all rows in one array, and
    the rows' offsets in it (one more than rows). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)
    offs = offs[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes stay under ``limit`` (a longer row is alone)."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def binary_column(blobs: list[bytes]) -> pa.Array:
    return pa.array(blobs, pa.binary())
