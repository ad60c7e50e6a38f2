"""Places of rows within their group, also of a group too large for one task;
sorted rows streamed to Python group by group."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def numbered(df: DataFrame, key: str, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, groups)``: ``df`` with ``at`` (a row number of the written table,
    rising with the order) and, by ``key`` (null is a group too), the rows of
    each group with ``first_at`` and ``len``. :func:`places` turns ``at`` into
    the place within the group.

    One sort by range over key and order, so the rows of a hot key lie in many
    partitions; the sorted rows are written, which fixes ``at``."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [F.col(c).asc_nulls_first() for c in [key, *order]]
    rows = written(df.repartitionByRange(parts, *columns).sortWithinPartitions(*columns)
                   .withColumn("at", F.monotonically_increasing_id()), name)
    groups = rows.groupBy(key).agg(F.min("at").alias("first_at"),
                                   F.count(F.lit(1)).alias("len"))
    return rows, groups


def places(rows: DataFrame, groups: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with ``pos``, the 1-based place in the group, and ``len``.

    ``at`` is a partition number and a count within it; the partitions' sizes,
    a table of one row for each partition, are broadcast."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(rows.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), name)

    def numbers(df: DataFrame, at: str, out: str) -> DataFrame:
        base = bases.select(F.col("part").alias("_part"), F.col("base").alias("_base"))
        place = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
        return df.join(F.broadcast(base), F.shiftright(at, 33) == F.col("_part")).withColumn(
            out, place + F.col("_base")).drop("_part", "_base")

    starts = numbers(groups, "first_at", "first_n").select(
        F.col(key).alias("_key"), "first_n", "len")
    joined = numbers(rows, "at", "n").join(
        starts, F.col(key).eqNullSafe(F.col("_key")))
    return joined.withColumn("pos", F.col("n") - F.col("first_n") + 1).drop(
        "_key", "n", "first_n")


def sorted_by(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """All rows of a group in one partition, in order, one group after another."""
    return df.repartition(*group).sortWithinPartitions(*group, *order)


def groups_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Of batches sorted by their first ``keys`` columns, each key with the
    lists of its rows' other columns."""
    current, held = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        at = 0
        names = list(zip(*columns[:keys]))
        while at < len(names):
            end = at + 1
            while end < len(names) and names[end] == names[at]:
                end += 1
            if held and names[at] == current:
                for have, column in zip(held, columns[keys:]):
                    have.extend(column[at:end])
            else:
                if held:
                    yield current, held
                current, held = names[at], [column[at:end] for column in columns[keys:]]
            at = end
    if held:
        yield current, held


def batched(rows: Iterator[tuple], names: list[str], types: list[pa.DataType],
            size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most ``size``."""
    held = []

    def batch():
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch()
            held = []
    if held:
        yield batch()
