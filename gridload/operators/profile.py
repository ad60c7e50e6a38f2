"""Profile of the loaded tables: row counts and schemas.

Counts are one Spark job for all tables (a union of global aggregates; each
scan reads no columns). For Parquet files :func:`footer_profile` reads counts
and the least and greatest value of columns from the files' footers alone. The schema rows come from each DataFrame's schema, a
property of the plan, and carry the table's row count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE = "tabela"
COUNT = "c"


def _count(name: str, df: DataFrame, alias: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(alias)).select(F.lit(name).alias(TABLE), alias)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table: ``tabela``, ``c`` (bigint)."""
    if not tables:
        raise ValueError("no tables to count")
    parts = [_count(name, df, COUNT) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def table_schemas(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per (table, column): ``tabela``, ``posicao`` (1-based),
    ``coluna``, ``tipo`` (Spark's type name), ``anulavel``, ``registros``
    (the table's row count)."""
    if not tables:
        raise ValueError("no tables to profile")
    parts = []
    for name, df in tables.items():
        fields = F.array(*[
            F.struct(F.lit(pos).alias("posicao"), F.lit(f.name).alias("coluna"),
                     F.lit(f.dataType.simpleString()).alias("tipo"),
                     F.lit(f.nullable).alias("anulavel"))
            for pos, f in enumerate(df.schema.fields, start=1)])
        parts.append(_count(name, df, "registros")
                     .select(TABLE, F.inline(fields), "registros"))
    return reduce(DataFrame.unionByName, parts)


def schema_json(df: DataFrame) -> dict:
    """The schema as JSON-compatible dict."""
    return df.schema.jsonValue()


# The statistics are pushed down by the second version of the file source.
FOOTER_CONF = {"spark.sql.sources.useV1SourceList": "",
               "spark.sql.parquet.aggregatePushdown": "true"}


def footer_session(spark: SparkSession) -> SparkSession:
    """A session of the same application in which aggregates without grouping
    are answered by Parquet footers; the caller's settings stay as they are."""
    own = spark.newSession()
    for key, value in FOOTER_CONF.items():
        own.conf.set(key, value)
    return own


def footer_profile(spark: SparkSession, paths: dict[str, str],
                   columns: dict[str, list[str]] | None = None) -> DataFrame:
    """One row for each (table, column) of ``columns`` and one of each table with
    null for the column: ``tabela``, ``coluna``, ``c`` (rows, or values that are
    not null), ``menor`` and ``maior`` (least and greatest value as text).

    Only footers are read, a row group's statistics in place of its rows. That
    holds for columns of numbers, dates and booleans. Text (whose statistics may
    be cut), timestamps (kept without an order in some files) and decimals are
    refused. The frame belongs to :func:`footer_session`'s session."""
    own = footer_session(spark)
    parts = []
    for name, path in paths.items():
        df = own.read.parquet(path)
        kinds = dict(df.dtypes)
        wanted = (columns or {}).get(name, [])
        bad = [c for c in wanted if kinds.get(c) not in
               ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "boolean")]
        if bad:
            raise ValueError(f"no footer statistics for {bad} of {name!r}: {kinds}")
        measures = [F.count(F.lit(1)).alias("n")]
        for k, c in enumerate(wanted):
            measures += [F.count(c).alias(f"c{k}"), F.min(c).alias(f"a{k}"),
                         F.max(c).alias(f"z{k}")]
        none = F.lit(None).cast("string")
        rows = [F.struct(none.alias("coluna"), F.col("n").alias(COUNT), none.alias("menor"),
                         none.alias("maior"))]
        rows += [F.struct(F.lit(c).alias("coluna"), F.col(f"c{k}").alias(COUNT),
                          F.col(f"a{k}").cast("string").alias("menor"),
                          F.col(f"z{k}").cast("string").alias("maior"))
                 for k, c in enumerate(wanted)]
        parts.append(df.agg(*measures).select(F.lit(name).alias(TABLE), F.inline(F.array(*rows))))
    if not parts:
        raise ValueError("no tables to profile")
    return reduce(DataFrame.unionByName, parts)
