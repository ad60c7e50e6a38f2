"""Column casts of the loading step, as JVM-side expressions.

Both run inside whole-stage codegen; neither pulls data into Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_instant(c: Column | str, fmt: str | None = None, ntz: bool = False) -> Column:
    """Text -> timestamp. Under ANSI mode (the default) unparsable text raises
    instead of turning into NULL; NULL stays NULL."""
    c = F.col(c) if isinstance(c, str) else c
    if ntz:
        return F.to_timestamp_ntz(c, F.lit(fmt)) if fmt else F.to_timestamp_ntz(c)
    return F.to_timestamp(c, fmt) if fmt else F.to_timestamp(c)


def to_text(c: Column | str) -> Column:
    """Any value -> its text; NULL stays NULL (never the string 'nan')."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("string")


def cast_timestamp(df: DataFrame, column: str, fmt: str | None = None,
                   ntz: bool = False) -> DataFrame:
    """Replace ``column`` by its timestamp value, keeping column order."""
    return df.withColumn(column, to_instant(column, fmt, ntz))


def cast_string(df: DataFrame, column: str) -> DataFrame:
    """Replace ``column`` by its text value, keeping column order."""
    return df.withColumn(column, to_text(column))
