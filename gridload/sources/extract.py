"""Extraction of one period from the partitioned measurement tables.

Sources are DataFrames (``spark.table(...)`` on a catalog or a partitioned
Parquet read). ``p_ano`` and ``p_mes`` are partition columns holding text,
month not zero-padded, so the equality filters become partition filters and
only the selected month's files are listed and read. They are compared as
text, which also covers a read that inferred them as integers (the cast is
dropped by the optimizer when they already are text). The other predicates are
pushed into the scan and only the projected columns are read. Output columns
are renamed to the domain names the loader expects.

Several periods at once come as a table of wanted (year, month) rows, joined on
the partition columns: the scan is pruned at run time by the rows of that table
(dynamic partition pruning), so months nobody wants are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import bounded_broadcast
from ..schemas import (DATA, PLANT_GUID, PLANT_ID, RESOURCE_GUID, RESOURCE_ID, SUBSYSTEM,
                       VALUE)

# Source column names and the default filter codes.
YEAR_COL = "p_ano"
MONTH_COL = "p_mes"
PERIOD_COL = "cod_periodograndeza"
CLASS_COL = "tip_classificacao"
START_COL = "din_referenciainicio"
SUBSYSTEM_COL = "id_subsistema"
INTERCHANGE_VALUE_COL = "val_intercambio"
GENERATION_VALUE_COL = "val_geracao"
RESOURCE_ID_COL = "id_recursogeracao"
RESOURCE_GUID_COL = "guid_recursogeracao"
DAILY_PERIOD = "DI"
INTERCHANGE_CLASS = "Consistido"
GENERATION_CLASS = "Preliminar"


def period_filter(year: int | str, month: int | str, period: str, classification: str):
    return ((F.col(YEAR_COL).cast("string") == F.lit(str(int(year))))
            & (F.col(MONTH_COL).cast("string") == F.lit(str(int(month))))
            & (F.col(PERIOD_COL) == F.lit(period))
            & (F.col(CLASS_COL) == F.lit(classification)))


def wanted_periods(periods: DataFrame) -> DataFrame:
    """Distinct (year, month) of the first two columns of ``periods``, as the
    partition columns hold them (text, not zero-padded). Rows that are no month,
    such as those with a null, are left out; this filter also lets the planner
    expect that the periods prune the scan."""
    year, month = (F.col(c).cast("int") for c in periods.columns[:2])
    return periods.where((year > 0) & month.between(1, 12)).select(
        year.cast("string").alias("_year"), month.cast("string").alias("_month")).distinct()


def in_periods(source: DataFrame, periods: DataFrame, period: str,
               classification: str) -> DataFrame:
    """The rows of ``source`` in any of ``periods`` with both codes. The periods
    are broadcast when they are measured to be few, which also lets the scan be
    pruned by them; a longer list is left to a merge join."""
    wanted, small = bounded_broadcast(wanted_periods(periods))
    rows = source.where((F.col(PERIOD_COL) == F.lit(period))
                        & (F.col(CLASS_COL) == F.lit(classification)))
    return rows.join(wanted if small else wanted.hint("merge"),
                     (F.col(YEAR_COL) == F.col("_year"))
                     & (F.col(MONTH_COL) == F.col("_month")), "left_semi")


def _selected(source: DataFrame, year, month, period: str, classification: str,
              periods: DataFrame | None) -> DataFrame:
    if periods is not None:
        return in_periods(source, periods, period, classification)
    return source.where(period_filter(year, month, period, classification))


def extract_interchange(source: DataFrame, year: int | str | None, month: int | str | None,
                        period: str = DAILY_PERIOD,
                        classification: str = INTERCHANGE_CLASS,
                        periods: DataFrame | None = None) -> DataFrame:
    """The interchange of one month, or with ``periods`` (a table whose first two
    columns are year and month) of all of them."""
    return (_selected(source, year, month, period, classification, periods)
            .select(F.col(START_COL).alias(DATA),
                    F.col(SUBSYSTEM_COL).alias(SUBSYSTEM),
                    F.col(INTERCHANGE_VALUE_COL).alias(VALUE)))


def extract_generation(source: DataFrame, year: int | str | None, month: int | str | None,
                       period: str = DAILY_PERIOD,
                       classification: str = GENERATION_CLASS,
                       periods: DataFrame | None = None) -> DataFrame:
    """The generation of one month, or with ``periods`` of all of them."""
    return (_selected(source, year, month, period, classification, periods)
            .select(F.col(START_COL).alias(DATA),
                    F.col(GENERATION_VALUE_COL).alias(VALUE),
                    F.col(RESOURCE_ID_COL).alias(PLANT_ID),
                    F.col(RESOURCE_GUID_COL).alias(PLANT_GUID)))


def extract_resources(source: DataFrame) -> DataFrame:
    return (source.where(F.col(SUBSYSTEM_COL).isNotNull())
            .select(F.col(RESOURCE_ID_COL).alias(RESOURCE_ID),
                    F.col(RESOURCE_GUID_COL).alias(RESOURCE_GUID),
                    F.col(SUBSYSTEM_COL).alias(SUBSYSTEM)))
