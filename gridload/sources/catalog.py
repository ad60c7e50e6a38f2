"""Named tables: register, load several at once, read back, drop.

Views are only the edge of the library (for SQL users); operators take and
return DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..schemas import GENERATION, INTERCHANGE, RESOURCES, schema_for
from .csv import read_csv_table

DOMAIN_TABLES = (GENERATION, INTERCHANGE, RESOURCES)


def register_table(name: str, df: DataFrame) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def drop_table(spark: SparkSession, name: str) -> bool:
    """Drop a temporary view; ``False`` if there was none."""
    return spark.catalog.dropTempView(name)


def select_all(spark: SparkSession, name: str) -> DataFrame:
    """Every column and row of a registered table or catalog table."""
    return spark.table(name).select("*")


def checked_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table whose columns must be ``schema``'s, by name and type
    (numbers of another width are cast to the declared one); columns come out in
    ``schema``'s order. Spark alone would read a misnamed column as NULL."""
    return checked_frame(spark.read.parquet(path), schema, path)


def checked_frame(df: DataFrame, schema: T.StructType, what: str) -> DataFrame:
    """``df`` held against ``schema`` as :func:`checked_parquet` does."""
    found = {f.name: f.dataType for f in df.schema}
    missing = [f.name for f in schema if f.name not in found]
    unexpected = [n for n in found if n not in schema.fieldNames()]
    if missing or unexpected:
        raise ValueError(f"columns of {what!r} are {list(found)}; expected {schema.fieldNames()} "
                         f"(missing {missing}, unexpected {unexpected})")
    columns = []
    for f in schema:
        kind = found[f.name]
        if kind == f.dataType:
            columns.append(df[f.name])
        elif isinstance(kind, T.NumericType) and isinstance(f.dataType, T.NumericType):
            columns.append(df[f.name].cast(f.dataType).alias(f.name))
        else:
            raise ValueError(f"column {f.name!r} of {what!r} is {kind.simpleString()}, not "
                             f"{f.dataType.simpleString()}")
    return df.select(*columns)


def load_tables(spark: SparkSession, paths: list[str], names: list[str], sep: str = ";",
                ntz: bool = False, schemas: dict | None = None, fmt: str = "csv",
                value_type: str = "double", register: bool = True,
                prefix: str = "") -> dict[str, DataFrame]:
    """Read ``paths[k]`` as table ``names[k]`` and, with ``register``, make it a
    view named ``prefix + names[k]``.

    The schema comes from ``schemas[name]`` or, for the three domain tables,
    from the name (measures as ``value_type``). ``fmt`` is ``csv`` (header,
    ``sep``) or ``parquet``. Both check the columns; a Parquet table with no
    known schema keeps the file's own. Lists of unequal length are an error.
    """
    if len(paths) != len(names):
        raise ValueError(f"{len(paths)} files but {len(names)} table names: {paths} / {names}")
    if len(set(names)) != len(names):
        raise ValueError(f"table names repeat: {names}")
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"unknown format {fmt!r}")
    tables = {}
    for path, name in zip(paths, names):
        schema = (schemas or {}).get(name)
        if schema is None and (fmt == "csv" or name in DOMAIN_TABLES):
            schema = schema_for(name, ntz, value_type)
        if fmt == "csv":
            df = read_csv_table(spark, path, schema, sep)
        elif schema is None:
            df = spark.read.parquet(path)
        else:
            df = checked_parquet(spark, path, schema)
        tables[name] = register_table(f"{prefix}{name}", df) if register else df
    return tables
