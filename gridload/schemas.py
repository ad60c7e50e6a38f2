"""Schemas of the three domain tables and the aggregation units.

Every reader takes one of these explicitly: no schema inference pass, which
at scale would mean reading the input twice.
"""

from __future__ import annotations

import re

from pyspark.sql import types as T

# Fixed values shared with the job this library re-expresses: the unit names
# and the domain column names.
DAILY = "diario"
MONTHLY = "mensal"
UNITS = (DAILY, MONTHLY)

DATA = "data"
SUBSYSTEM = "subsistema"
VALUE = "valor"
PLANT_ID = "id_usina"
PLANT_GUID = "guid_usina"
RESOURCE_ID = "id_recurso"
RESOURCE_GUID = "guid_recurso"

INTERCHANGE = "intercambio"
GENERATION = "geracao"
RESOURCES = "recursos"


def _ts(ntz: bool) -> T.DataType:
    return T.TimestampNTZType() if ntz else T.TimestampType()


def _value(value_type: str | T.DataType) -> T.DataType:
    """Measure type: ``double`` by default; ``decimal(p,s)`` makes sums exact."""
    if isinstance(value_type, T.DataType):
        return value_type
    text = value_type.strip().lower()
    if text == "double":
        return T.DoubleType()
    m = re.fullmatch(r"decimal\(\s*(\d+)\s*,\s*(\d+)\s*\)", text)
    if m:
        return T.DecimalType(int(m.group(1)), int(m.group(2)))
    raise ValueError(f"value type must be 'double' or 'decimal(p,s)', not {value_type!r}")


def interchange_schema(ntz: bool = False, value_type: str | T.DataType = "double"
                       ) -> T.StructType:
    """`intercambio`: net interchange per subsystem and instant."""
    return T.StructType([
        T.StructField(DATA, _ts(ntz), True),
        T.StructField(SUBSYSTEM, T.StringType(), True),
        T.StructField(VALUE, _value(value_type), True),
    ])


def generation_schema(ntz: bool = False, value_type: str | T.DataType = "double"
                      ) -> T.StructType:
    """`geracao`: generation per plant and instant."""
    return T.StructType([
        T.StructField(DATA, _ts(ntz), True),
        T.StructField(VALUE, _value(value_type), True),
        T.StructField(PLANT_ID, T.StringType(), True),
        T.StructField(PLANT_GUID, T.StringType(), True),
    ])


def resources_schema() -> T.StructType:
    """`recursos`: plant -> subsystem dimension, all text."""
    return T.StructType([
        T.StructField(RESOURCE_ID, T.StringType(), True),
        T.StructField(RESOURCE_GUID, T.StringType(), True),
        T.StructField(SUBSYSTEM, T.StringType(), True),
    ])


def schema_for(table: str, ntz: bool = False, value_type: str | T.DataType = "double"
               ) -> T.StructType:
    """Schema of a domain table by its name."""
    if table == INTERCHANGE:
        return interchange_schema(ntz, value_type)
    if table == GENERATION:
        return generation_schema(ntz, value_type)
    if table == RESOURCES:
        return resources_schema()
    raise ValueError(
        f"unknown table {table!r}; expected one of "
        f"{INTERCHANGE!r}, {GENERATION!r}, {RESOURCES!r} or an explicit schema")


def check_unit(unit: str) -> str:
    """Return ``unit`` if it is a known aggregation unit, else raise.

    Checked before any plan is built, so a bad unit never reaches Spark.
    """
    if unit not in UNITS:
        raise ValueError(f"unknown aggregation unit {unit!r}; expected one of {UNITS}")
    return unit


def group_keys(unit: str) -> list[str]:
    """Grouping keys of a unit: daily groups by the raw instant (no
    truncation to a calendar day), monthly pools every row of a subsystem."""
    check_unit(unit)
    return [SUBSYSTEM, DATA] if unit == DAILY else [SUBSYSTEM]
