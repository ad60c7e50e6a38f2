"""Mergeable state of the two aggregates, kept period by period.

The state of some rows is, per subsystem and instant, their sum, how many of
them have a value, and how many they are. States of different rows merge by
adding, in any order, so a table of states by period (a day, a month, a load)
takes new periods as they arrive: only the rows of the new period are read.
Delivering a period again replaces what it brought. Both units come from the
same state: the daily sum by adding sums, the monthly mean of rows as the
pooled sum over the pooled count.

The table is Parquet partitioned by ``period``; a write overwrites the
partitions it has rows for and no other (dynamic overwrite), through Spark's
commit protocol, so a retried write leaves one set of rows. DECIMAL measures
add exactly, so the incremental load equals the full one bit for bit; sums of
doubles may differ in the last digit by the order of adding.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.measures import mean_of_parts
from ..schemas import DAILY, DATA, SUBSYSTEM, VALUE, group_keys
from ..sources.files import path_exists, subfolders
from .aggregate import attach_subsystem
from .joins import DEFAULT_BROADCAST_MAX_BYTES, DEFAULT_BROADCAST_MAX_ROWS
from .load import compute_load

PERIOD = "period"
SUM, COUNT, ROWS = "valor_sum", "valor_count", "rows"
MEASURES = (SUM, COUNT, ROWS)
_KEYS = [SUBSYSTEM, DATA]


def _state(rows: DataFrame, extra: list[str]) -> DataFrame:
    return rows.groupBy(*extra, *_KEYS).agg(
        F.sum(VALUE).alias(SUM), F.count(VALUE).alias(COUNT), F.count(F.lit(1)).alias(ROWS))


def interchange_state(interchange: DataFrame, period: str | None = None) -> DataFrame:
    """The state of interchange rows; ``period`` names a column to keep apart by."""
    return _state(interchange, [period] if period else [])


def generation_state(generation: DataFrame, resources: DataFrame, period: str | None = None,
                     broadcast_max_rows: int | None = DEFAULT_BROADCAST_MAX_ROWS,
                     broadcast_max_bytes: int = DEFAULT_BROADCAST_MAX_BYTES) -> DataFrame:
    """The state of generation rows by the subsystem of their plant (inner join,
    as in :func:`~gridload.operators.aggregate.attach_subsystem`). A plant that
    changes its subsystem counts for periods as they are delivered."""
    return _state(attach_subsystem(generation, resources, broadcast_max_rows,
                                   broadcast_max_bytes), [period] if period else [])


def merge_states(*states: DataFrame) -> DataFrame:
    """The state of all rows of ``states``: partial sums, then one shuffle by key."""
    if not states:
        raise ValueError("no states to merge")
    columns = [*_KEYS, *MEASURES]
    both = reduce(DataFrame.unionByName, [s.select(*columns) for s in states])
    return both.groupBy(*_KEYS).agg(*[F.sum(c).alias(c) for c in MEASURES])


def aggregate_of_state(state: DataFrame, unit: str) -> DataFrame:
    """The aggregate of ``unit`` as the full aggregation gives it:
    ``subsistema``[, ``data``], ``valor``. The state may hold several rows a key
    (periods that have not been merged)."""
    keys = group_keys(unit)
    measure = F.sum(SUM).cast("double") if unit == DAILY else mean_of_parts(SUM, COUNT)
    return state.groupBy(*keys).agg(measure.alias(VALUE))


def load_of_states(generation: DataFrame, interchange: DataFrame, unit: str) -> DataFrame:
    """The load from the states of both sides."""
    return compute_load(aggregate_of_state(generation, unit),
                        aggregate_of_state(interchange, unit), unit)


def put_periods(state: DataFrame, path: str, period: str | None = None) -> str:
    """Stores a state: under the one ``period`` given, or under those of its
    column ``period``. A period stored before is replaced as a whole, also when
    it has fewer keys now; an empty state stores nothing."""
    rows = state if period is None else state.withColumn(PERIOD, F.lit(period))
    rows = rows.select(*_KEYS, *MEASURES, F.col(PERIOD).cast("string").alias(PERIOD))
    if rows.schema[PERIOD].nullable:
        rows = rows.withColumn(PERIOD, F.coalesce(PERIOD, F.raise_error(F.lit("no period"))))
    # rows of a period meet in few tasks, a large one is split
    rows.hint("rebalance", PERIOD).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(PERIOD).parquet(path)
    return path


def stored_state(spark: SparkSession, path: str,
                 periods: list[str] | None = None) -> DataFrame | None:
    """The stored rows, of all or some periods (only their folders are read);
    None when nothing is stored. Measures have the stored files' types; periods
    are text, never guessed from how they look."""
    if not path_exists(spark, path) or not subfolders(spark, path):
        return None
    stored = spark.read.parquet(path).schema
    schema = T.StructType([*[stored[c] for c in (*_KEYS, *MEASURES)],
                           T.StructField(PERIOD, T.StringType())])
    rows = spark.read.schema(schema).parquet(path)
    return rows if periods is None else rows.where(F.col(PERIOD).isin(*periods))


class LoadState:
    """The states of both sides under one folder, as periods arrive."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, generation: DataFrame, interchange: DataFrame, resources: DataFrame,
            period: str, **broadcast) -> None:
        """Takes in the rows of one period, reading no others."""
        put_periods(generation_state(generation, resources, **broadcast),
                    f"{self.path}/generation", period)
        put_periods(interchange_state(interchange), f"{self.path}/interchange", period)

    def side(self, name: str, periods: list[str] | None = None) -> DataFrame:
        """The stored rows of ``generation`` or ``interchange``; a side that has
        had none yet is empty, with the other's types."""
        found = {n: stored_state(self.spark, f"{self.path}/{n}", periods)
                 for n in ("generation", "interchange")}
        if all(rows is None for rows in found.values()):
            raise ValueError(f"no state stored under {self.path!r}")
        other = next(rows for rows in found.values() if rows is not None)
        return other.where(F.lit(False)) if found[name] is None else found[name]

    def load(self, unit: str, periods: list[str] | None = None) -> DataFrame:
        """The load of all periods stored, or of ``periods``."""
        return load_of_states(self.side("generation", periods), self.side("interchange", periods),
                              unit)

    def compact(self, name: str, into: str, periods: list[str]) -> None:
        """Merges the rows of several periods into one, stored as period ``into``
        of ``name + '-compact'``: the long past as one row a key."""
        put_periods(merge_states(self.side(name, periods)), f"{self.path}/{name}-compact", into)
