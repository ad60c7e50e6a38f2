"""CSV reading that sets bad lines aside instead of failing or losing them.

A line is bad when Spark's parser can't fit it to the schema: a field that is no
number or instant of its column, or another number of fields. Good lines are
read as by :mod:`.csv`; bad ones are rows of a table of their own with the file,
the reason and the line as it stands. Every data line is in exactly one of the
two, so their counts add up to the lines read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import schema_for
from .csv import _file_order, read_header

CORRUPT = "_corrupt_line"
FILE, REASON, COLUMN, LINE = "arquivo", "motivo", "coluna", "linha"
# The reasons.
BAD_VALUE, BAD_FIELDS = "bad value", "wrong number of fields"


@dataclass
class Quarantined:
    """``good``: rows of the schema; ``bad``: file, reason, column (of a bad
    value) and line of the others."""

    good: DataFrame
    bad: DataFrame


def _reason(schema: T.StructType, sep: str) -> tuple[Column, Column]:
    """Reason and column of a bad line: the first field, in the file's order, that
    has text and yet no value. A line with another number of fields is bad for
    that whatever they hold."""
    ddl = ", ".join(f"`{name}` string" for name in [*schema.fieldNames(), CORRUPT])
    text = F.from_csv(CORRUPT, ddl, {"sep": sep, "mode": "PERMISSIVE",
                                     "columnNameOfCorruptRecord": CORRUPT})
    column = F.coalesce(*[F.when(F.col(name).isNull() & (text[name] != ""), F.lit(name))
                          for name in schema.fieldNames()])
    whole = text[CORRUPT].isNull()
    return F.when(whole, BAD_VALUE).otherwise(BAD_FIELDS), F.when(whole, column)


def read_quarantined(spark: SparkSession, path: str | list[str], schema: T.StructType,
                     sep: str = ";", timestamp_format: str | None = None) -> Quarantined:
    """Header CSV read with a fixed schema; the header itself must be right.

    Both frames read the files; a bad line is split once more for its reason. All
    fields are parsed whatever is selected."""
    if CORRUPT in schema.fieldNames():
        raise ValueError(f"a column may not be named {CORRUPT!r}")
    in_file = _file_order(schema, read_header(spark, path, sep), path)
    reader = (spark.read.schema(T.StructType([*in_file.fields,
                                              T.StructField(CORRUPT, T.StringType())]))
              .option("sep", sep).option("header", True).option("enforceSchema", False)
              .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT))
    if timestamp_format:
        reader = (reader.option("timestampFormat", timestamp_format)
                  .option("timestampNTZFormat", timestamp_format))
    rows = reader.csv(path)
    # Always true, but names every field: a scan that parses some fields only
    # would take a line with another bad field for good.
    for name in in_file.fieldNames():
        rows = rows.where(F.col(name).isNull() | F.col(name).isNotNull())
    reason, column = _reason(in_file, sep)
    bad = rows.where(F.col(CORRUPT).isNotNull()).select(
        F.col("_metadata.file_path").alias(FILE), reason.alias(REASON), column.alias(COLUMN),
        F.col(CORRUPT).alias(LINE))
    good = rows.where(F.col(CORRUPT).isNull()).select(*schema.fieldNames())
    return Quarantined(good, bad)


def read_tables_quarantined(spark: SparkSession, paths: list[str], names: list[str],
                            sep: str = ";", ntz: bool = False, value_type: str = "double",
                            schemas: dict | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Several tables by position, and the bad lines of all with their table."""
    if len(paths) != len(names):
        raise ValueError(f"{len(paths)} files but {len(names)} table names: {paths} / {names}")
    read = {n: read_quarantined(spark, p, (schemas or {}).get(n) or schema_for(n, ntz, value_type),
                                sep) for p, n in zip(paths, names)}
    bad = reduce(DataFrame.unionByName,
                 [q.bad.select(F.lit(n).alias("tabela"), "*") for n, q in read.items()])
    return {n: q.good for n, q in read.items()}, bad
