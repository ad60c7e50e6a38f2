"""Ordering of the load and its peak.

Ties are broken by ``subsistema`` then ``data`` so that every call returns the
same row. ``DESC`` puts NaN first and NULL last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import DATA, SUBSYSTEM, VALUE

def _order_cols(df: DataFrame) -> list:
    cols = [F.col(VALUE).desc_nulls_last(), F.col(SUBSYSTEM).asc_nulls_last()]
    if DATA in df.columns:
        cols.append(F.col(DATA).asc_nulls_last())
    return cols


def order_load(load: DataFrame) -> DataFrame:
    """The load, highest value first (a total sort: range-partitioned, so it
    scales, but only ask for it when the whole order is the output)."""
    return load.orderBy(*_order_cols(load))


def top_loads(load: DataFrame, n: int, position: str = "pos") -> DataFrame:
    """The ``n`` highest rows with their 1-based position.

    ``orderBy().limit(n)`` plans as a per-partition bounded heap
    (``TakeOrderedAndProject``); the position is numbered over those ``n``
    rows only, so the un-partitioned window never sees more than ``n`` rows.
    Every task keeps a heap of ``n`` rows and these meet in one task: for a long
    ordering take :func:`order_load`, which sorts by range.
    """
    if n <= 0:
        raise ValueError("n must be positive")
    order = _order_cols(load)
    head = load.orderBy(*order).limit(n)
    return head.withColumn(position, F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def load_positions(load: DataFrame, path: str, position: str = "pos") -> DataFrame:
    """Every row of the load with its 1-based position in the whole order.

    The load is sorted by range and written under ``path``; within a range
    partition rows count up, and the sizes of the partitions before it are added.
    So no task sees more than its range (a window over everything would be one
    task), and the written table fixes what the numbers refer to. Only the
    partitions' sizes, as many numbers as there are tasks, reach the driver.
    """
    spark = load.sparkSession
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    order_load(load).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    schema = T.StructType([*load.schema.fields, T.StructField("_at", T.LongType())])
    rows = spark.read.schema(schema).parquet(path)
    sizes = {r["part"]: r["n"] for r in rows.groupBy(part.alias("part")).agg(
        F.count(F.lit(1)).alias("n")).collect()}
    before, start = [], 0
    for k in sorted(sizes):
        before.append((k, start))
        start += sizes[k]
    bases = F.broadcast(spark.createDataFrame(before, "_part bigint, _base bigint"))
    return rows.join(bases, part == F.col("_part")).select(
        *load.columns, (within + F.col("_base") + 1).alias(position))


def peak_load(load: DataFrame) -> DataFrame:
    """The most demanding subsystem (and instant, in daily mode): one row, or
    none when the load is empty."""
    return load.orderBy(*_order_cols(load)).limit(1)


def peak_load_per_day(load: DataFrame) -> DataFrame:
    """For each instant, the subsystem(s) with the highest load; ties are all
    kept (``rank() = 1``).

    Spark plans the ``rank = 1`` filter with a map-side ``WindowGroupLimit``,
    so each task keeps only its per-instant leaders before the shuffle.
    """
    if DATA not in load.columns:
        raise ValueError("peak_load_per_day needs the daily load (a 'data' column)")
    w = Window.partitionBy(DATA).orderBy(F.col(VALUE).desc_nulls_last())
    return (load.withColumn("_rnk", F.rank().over(w))
            .where(F.col("_rnk") == 1)
            .select(SUBSYSTEM, DATA, VALUE))
