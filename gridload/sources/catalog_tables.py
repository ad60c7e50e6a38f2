"""Tables of the session catalog: partitioned, bucketed, and published run by run.

All are external tables over a folder the caller names, so dropping a table
leaves its files. Names may have a database (``db.table``).

* **Partitioned** (:func:`create_partitioned`): partitions are registered in the
  catalog, so a filter on the partition columns is answered there and only the
  folders it leaves are listed. :func:`append_partitions` writes rows and
  registers what they bring; :func:`recover_partitions` registers folders that
  came from elsewhere.
* **Bucketed** (:func:`write_bucketed`): rows lie in files by the hash of their
  keys; two tables of equal keys and buckets join without a shuffle.
* **Published** (:func:`publish_run`): a run's rows are written to a folder of
  their own and become visible by one change of the run's partition location in
  the catalog. A reader of the table sees the rows of before or of after,
  never a part, and other runs stay as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import make_folder, subfolders

RUN = "run_id"


def quoted(name: str) -> str:
    """``db.table`` with each part in backticks."""
    return ".".join(f"`{part.replace('`', '``')}`" for part in name.split("."))


def _literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def create_partitioned(spark: SparkSession, name: str, schema: T.StructType,
                       partition_by: list[str], location: str, fmt: str = "parquet") -> str:
    """Creates the external table ``name`` over ``location``, if it is not there,
    and registers the partition folders found. Partition columns come last."""
    missing = [c for c in partition_by if c not in schema.fieldNames()]
    if missing or not partition_by:
        raise ValueError(f"partition columns {partition_by} must be columns; missing {missing}")
    fields = [f for f in schema if f.name not in partition_by]
    fields += [schema[c] for c in partition_by]
    columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in fields)
    by = ", ".join(quoted(c) for c in partition_by)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {quoted(name)} ({columns}) USING {fmt} "
              f"PARTITIONED BY ({by}) LOCATION {_literal(make_folder(spark, location))}")
    recover_partitions(spark, name)
    return name


def recover_partitions(spark: SparkSession, name: str) -> None:
    """Registers partition folders of the table's location that the catalog does
    not know yet."""
    spark.sql(f"ALTER TABLE {quoted(name)} RECOVER PARTITIONS")


def partition_columns(spark: SparkSession, name: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(name) if c.isPartition]


def partitions(spark: SparkSession, name: str) -> DataFrame:
    """One row for each registered partition: its columns, as text."""
    columns = partition_columns(spark, name)
    listed = spark.sql(f"SHOW PARTITIONS {quoted(name)}")
    part = F.split("partition", "/")
    return listed.select(*[F.substring_index(part[k], "=", -1).alias(c)
                           for k, c in enumerate(columns)])


def append_partitions(df: DataFrame, name: str) -> None:
    """Appends rows to a partitioned table; new partitions are registered.

    Rows are brought together by partition so that few files are written, but
    only as far as sizes allow (``REBALANCE``): adaptive execution splits a
    partition that is larger than the advisory size over several tasks, so a
    month with most of the rows is not one task."""
    spark = df.sparkSession
    columns = [f.name for f in spark.table(name).schema]
    by = partition_columns(spark, name)
    df.select(*columns).hint("rebalance", *by).write.insertInto(name)


def drop_catalog_table(spark: SparkSession, name: str) -> None:
    """Drops the table; its files stay (it is external)."""
    spark.sql(f"DROP TABLE IF EXISTS {quoted(name)}")


def write_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int, location: str) -> str:
    """Writes ``df`` as a table bucketed and sorted by ``keys``, one file a
    bucket: tasks hold the rows of one bucket, as a bucket is the hash partition
    of that number. For tables with few rows a key, such as aggregates; a key
    with most of the rows would be one file."""
    if buckets < 1:
        raise ValueError("buckets must be positive")
    (df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys)
     .sortBy(*keys).option("path", location).saveAsTable(name))
    return name


def publish_run(df: DataFrame, name: str, run_id: str, location: str) -> str:
    """Makes ``df`` the rows of run ``run_id`` of table ``name``, which is created
    over ``location`` if it is not there; returns the folder of the rows.

    The rows are written aside first. A write that fails, or a task that runs
    twice, is never seen: nothing refers to its folder. Folders of rows that were
    replaced stay for readers that still use them; :func:`stale_folders` lists
    them for clearing."""
    spark = df.sparkSession
    if RUN in df.columns:
        df = df.drop(RUN)
    folder = f"{location.rstrip('/')}/{RUN}={run_id}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    schema = T.StructType([*df.schema.fields, T.StructField(RUN, T.StringType())])
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {quoted(name)} ({columns}) USING parquet "
                  f"PARTITIONED BY ({quoted(RUN)}) LOCATION {_literal(location)}")
    found = {f.name: f.dataType for f in spark.table(name).schema}
    if found != {f.name: f.dataType for f in schema}:
        raise ValueError(f"table {name!r} has columns {found}; not {schema.simpleString()}")
    spec = f"PARTITION ({quoted(RUN)} = {_literal(run_id)})"
    known = partitions(spark, name).where(F.col(RUN) == run_id).count() > 0
    if known:
        spark.sql(f"ALTER TABLE {quoted(name)} {spec} SET LOCATION {_literal(folder)}")
    else:
        spark.sql(f"ALTER TABLE {quoted(name)} ADD {spec} LOCATION {_literal(folder)}")
    spark.catalog.refreshTable(name)
    return folder


def published_folder(spark: SparkSession, name: str, run_id: str) -> str:
    rows = spark.sql(f"DESCRIBE EXTENDED {quoted(name)} PARTITION ({quoted(RUN)} = "
                     f"{_literal(run_id)})").where("col_name = 'Location'").collect()
    return rows[0]["data_type"].rstrip("/")


def stale_folders(spark: SparkSession, name: str, run_id: str, location: str) -> list[str]:
    """Folders of earlier publications of a run, which no new reader opens."""
    live = published_folder(spark, name, run_id).rsplit("/", 1)[-1]
    return [f for f in subfolders(spark, f"{location.rstrip('/')}/{RUN}={run_id}")
            if f.rsplit("/", 1)[-1] != live]
