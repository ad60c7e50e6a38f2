"""Writers, and the collect.

Writes are parallel, one file per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Instants are written with microseconds (lossless) and, for zoned timestamps,
# the offset: 2018-01-27T00:00:00.000000Z.
INSTANT_WRITE_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
LOCAL_WRITE_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def write_csv(df: DataFrame, path: str, sep: str = ";", mode: str = "errorifexists",
              header: bool = True, partition_by: list[str] | None = None,
              only_partitions: bool = False) -> str:
    """Write ``df`` as separator CSV with a header row; returns ``path``. With
    ``only_partitions`` an overwrite replaces the partitions written, no others."""
    w = (df.write.mode(mode)
         .option("sep", sep)
         .option("header", header)
         .option("timestampFormat", INSTANT_WRITE_FORMAT)
         .option("timestampNTZFormat", LOCAL_WRITE_FORMAT))
    if partition_by:
        w = w.partitionBy(*partition_by)
    if only_partitions:
        w = w.option("partitionOverwriteMode", "dynamic")
    w.csv(path)
    return path


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists",
                  partition_by: list[str] | None = None, only_partitions: bool = False) -> str:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if only_partitions:
        w = w.option("partitionOverwriteMode", "dynamic")
    w.parquet(path)
    return path


def to_rows(df: DataFrame, max_rows: int | None = None) -> list[list]:
    """All rows as a list of lists, for aggregated results: they must fit on the
    driver. ``max_rows``, if given, raises beyond that many rows instead of
    collecting them."""
    if max_rows is None:
        return [list(r) for r in df.collect()]
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"result has more than {max_rows} rows; write it instead of collecting")
    return [list(r) for r in rows]


def append_rows(spark: SparkSession, rows: list[tuple], schema: T.StructType, path: str) -> str:
    """Append a few driver-side rows (run metadata) to a Parquet table."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return path
