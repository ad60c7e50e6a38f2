"""Typed CSV readers for the three domain tables.

Files carry a header row and a separator (``;`` by default). The header is
checked on the driver against the expected column names first, so a wrong
file fails with a clear message before any task runs; columns may come in
any order. Values are then parsed with a fixed schema (no inference pass),
``enforceSchema=False`` so every file's header is validated again by the
scan, and ``FAILFAST`` so malformed values raise instead of turning into
NULL (``mode="PERMISSIVE"`` turns them into NULL instead, for loads where one
bad field must not fail the whole job). An empty field is NULL; ``NaN`` is
read as NaN.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..schemas import GENERATION, INTERCHANGE, RESOURCES, schema_for

# Instants in the files look like 2018-01-27T00:00:00.000Z. Without an explicit
# pattern Spark parses ISO-8601 text (any fraction length, optional zone).


def read_header(spark: SparkSession, path: str | list[str], sep: str = ";") -> list[str]:
    """Column names in the header of the first file (reads one line)."""
    return spark.read.option("sep", sep).option("header", True).csv(path).columns


def _file_order(schema: T.StructType, header: list[str], path) -> T.StructType:
    expected = {f.name: f for f in schema.fields}
    missing = [n for n in expected if n not in header]
    unexpected = [n for n in header if n not in expected]
    if missing or unexpected or len(header) != len(set(header)):
        raise ValueError(
            f"CSV header of {path!r} is {header}; expected the columns "
            f"{list(expected)} (missing {missing}, unexpected {unexpected})")
    return T.StructType([expected[n] for n in header])


def read_csv_table(spark: SparkSession, path: str | list[str], schema: T.StructType,
                   sep: str = ";", check_header: bool = True,
                   timestamp_format: str | None = None, mode: str = "FAILFAST") -> DataFrame:
    """Read header CSV with a fixed schema; columns come out in schema order."""
    file_schema = (_file_order(schema, read_header(spark, path, sep), path)
                   if check_header else schema)
    reader = (spark.read.schema(file_schema)
              .option("sep", sep)
              .option("header", True)
              .option("enforceSchema", not check_header)
              .option("mode", mode))
    if timestamp_format:
        reader = (reader.option("timestampFormat", timestamp_format)
                  .option("timestampNTZFormat", timestamp_format))
    return reader.csv(path).select(*schema.fieldNames())


def read_domain_csv(spark: SparkSession, path, table: str, sep: str = ";",
                    ntz: bool = False, value_type: str = "double", **kw) -> DataFrame:
    return read_csv_table(spark, path, schema_for(table, ntz, value_type), sep, **kw)


def read_interchange(spark: SparkSession, path, sep: str = ";", ntz: bool = False,
                     value_type: str = "double", **kw) -> DataFrame:
    return read_domain_csv(spark, path, INTERCHANGE, sep, ntz, value_type, **kw)


def read_generation(spark: SparkSession, path, sep: str = ";", ntz: bool = False,
                    value_type: str = "double", **kw) -> DataFrame:
    return read_domain_csv(spark, path, GENERATION, sep, ntz, value_type, **kw)


def read_resources(spark: SparkSession, path, sep: str = ";", **kw) -> DataFrame:
    return read_domain_csv(spark, path, RESOURCES, sep, **kw)
