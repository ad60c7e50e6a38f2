"""The registry of runs: metric rows by run and attempt, each stored once.

Every attempt of a run has a partition of its own, ``entry=<run>.<attempt>``,
which a write replaces as a whole (dynamic overwrite, Spark's commit protocol).
So a write that is retried, or rows that are put twice, leave one set; and an
attempt that failed keeps its rows, with a ``failed`` stage, beside the attempt
that made good. :func:`runs` shows each run by its last attempt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import path_exists, subfolders
from .metrics import METRICS_SCHEMA, STAGE

RUN, ATTEMPT, ENTRY = "run_id", "attempt", "entry"
# Fixed value: the stage of a run that ended with an error.
STAGE_FAILED = "failed"

REGISTRY_SCHEMA = T.StructType([*METRICS_SCHEMA.fields, T.StructField(ATTEMPT, T.IntegerType()),
                                T.StructField(ENTRY, T.StringType())])


def attempts(spark: SparkSession, path: str) -> DataFrame:
    """All metric rows of all attempts; none when nothing is stored."""
    if not path_exists(spark, path) or not subfolders(spark, path):
        return spark.createDataFrame([], REGISTRY_SCHEMA)
    return spark.read.schema(REGISTRY_SCHEMA).parquet(path)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The metric rows of each run's last attempt."""
    rows = attempts(spark, path)
    last = rows.groupBy(F.col(RUN).alias("_run")).agg(F.max(ATTEMPT).alias("_last"))
    return rows.join(last, (F.col(RUN) == F.col("_run"))
                     & (F.col(ATTEMPT) == F.col("_last"))).select(*REGISTRY_SCHEMA.fieldNames())


def run_states(spark: SparkSession, path: str) -> DataFrame:
    """One row a run: ``run_id``, ``attempts``, whether the last one ``failed``."""
    last_failed = F.max_by(F.col(STAGE) == STAGE_FAILED,
                           F.struct(ATTEMPT, (F.col(STAGE) == STAGE_FAILED).alias("f")))
    return attempts(spark, path).groupBy(RUN).agg(
        F.countDistinct(ATTEMPT).alias("attempts"), last_failed.alias("failed"))


def next_attempt(spark: SparkSession, path: str, run_id: str) -> int:
    """1 for a run that the registry does not know."""
    rows = attempts(spark, path).where(F.col(RUN) == run_id)
    return (rows.agg(F.max(ATTEMPT)).collect()[0][0] or 0) + 1


def put_attempt(spark: SparkSession, rows: list[tuple], path: str, run_id: str,
                attempt: int) -> str:
    """Stores the metric rows of one attempt, in place of what it had."""
    other = {r[0] for r in rows} - {run_id}
    if other:
        raise ValueError(f"rows of other runs: {sorted(other)}")
    df = spark.createDataFrame(rows, METRICS_SCHEMA).withColumns(
        {ATTEMPT: F.lit(attempt), ENTRY: F.lit(f"{run_id}.{attempt}")})
    df.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        ENTRY).parquet(path)
    return path
