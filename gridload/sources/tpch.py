"""The driver's TPC-H-like tables mapped onto the three domain tables.

* ``recursos``    = supplier x nation x region (plant = supplier,
                    subsystem = region name)
* ``geracao``     = lineitem (plant = ``l_suppkey``, value = ``l_quantity``)
* ``intercambio`` = orders by customer region, ``o_totalprice``, negated for
                    status ``F``

Values are DECIMAL(18,4) so sums are exact whatever the task order; instants
stay ``timestamp_ntz`` as stored. Plant keys stay in their stored ``bigint``:
equality of integers is equality of their text, so the join result is the same
as on text ids, without casting every fact row to text and hashing strings
(the long-keyed hash relation is much cheaper). Queries that output a key
render it as text. The catalog-shaped sources (Hive column
names plus ``p_ano``/``p_mes`` text partitions) feed the extraction operators.

Joins to ``nation``/``region`` are left to Spark's size-based choice: both
are tiny files, so they are broadcast; ``orders`` x ``customer`` is a shuffle
join, where AQE splits a customer that owns a large share of the orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import (DATA, PLANT_GUID, PLANT_ID, RESOURCE_GUID, RESOURCE_ID, SUBSYSTEM,
                       VALUE)
from . import extract as X

VALUE_TYPE = "decimal(18,4)"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a lazy scan, with the files and the columns it has now."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _region_of_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    return (nation.join(region, nation.n_regionkey == region.r_regionkey, "inner")
            .select(nation.n_nationkey.alias("_nationkey"), region.r_name.alias(SUBSYSTEM)))


def generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_shipdate").alias(DATA),
                     F.col("l_quantity").cast(VALUE_TYPE).alias(VALUE),
                     F.col("l_partkey").cast("string").alias(PLANT_ID),
                     F.col("l_suppkey").alias(PLANT_GUID))


def resources(spark: SparkSession, sf_dir: str, geo: DataFrame | None = None) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier")
    geo = geo if geo is not None else _region_of_nation(spark, sf_dir)
    return (s.join(geo, s.s_nationkey == geo._nationkey, "inner")
            .select(s.s_nationkey.cast("string").alias(RESOURCE_ID),
                    s.s_suppkey.alias(RESOURCE_GUID),
                    geo[SUBSYSTEM]))


def interchange(spark: SparkSession, sf_dir: str, geo: DataFrame | None = None) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer")
    geo = geo if geo is not None else _region_of_nation(spark, sf_dir)
    signed = F.when(o.o_orderstatus == "F", -o.o_totalprice).otherwise(o.o_totalprice)
    oc = o.join(c, o.o_custkey == c.c_custkey, "inner")
    return (oc.join(geo, oc.c_nationkey == geo._nationkey, "inner")
            .select(o.o_orderdate.alias(DATA), geo[SUBSYSTEM],
                    signed.cast(VALUE_TYPE).alias(VALUE)))


def domain_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    geo = _region_of_nation(spark, sf_dir)
    return {"geracao": generation(spark, sf_dir),
            "intercambio": interchange(spark, sf_dir, geo),
            "recursos": resources(spark, sf_dir, geo)}


def _partitions(ts: F.Column) -> list[F.Column]:
    return [F.year(ts).cast("string").alias(X.YEAR_COL),
            F.month(ts).cast("string").alias(X.MONTH_COL)]


def interchange_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` shaped like the interchange catalog table: status plays the
    period code, priority the classification."""
    o = read_table(spark, sf_dir, "orders")
    return o.select(o.o_orderdate.alias(X.START_COL),
                    o.o_custkey.cast("string").alias(X.SUBSYSTEM_COL),
                    o.o_totalprice.alias(X.INTERCHANGE_VALUE_COL),
                    *_partitions(o.o_orderdate),
                    o.o_orderstatus.alias(X.PERIOD_COL),
                    o.o_orderpriority.alias(X.CLASS_COL))


def generation_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` shaped like the generation catalog table: return flag plays
    the period code, line status the classification."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(li.l_shipdate.alias(X.START_COL),
                     li.l_quantity.alias(X.GENERATION_VALUE_COL),
                     li.l_partkey.cast("string").alias(X.RESOURCE_ID_COL),
                     li.l_suppkey.cast("string").alias(X.RESOURCE_GUID_COL),
                     *_partitions(li.l_shipdate),
                     li.l_returnflag.alias(X.PERIOD_COL),
                     li.l_linestatus.alias(X.CLASS_COL))


def resources_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` shaped like the plant catalog table; segment MACHINERY
    stands for a plant with no subsystem (NULL)."""
    c = read_table(spark, sf_dir, "customer")
    return c.select(c.c_custkey.cast("string").alias(X.RESOURCE_ID_COL),
                    c.c_name.alias(X.RESOURCE_GUID_COL),
                    F.nullif(c.c_mktsegment, F.lit("MACHINERY")).alias(X.SUBSYSTEM_COL))
