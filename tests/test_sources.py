"""Table reads, checked Parquet input, CSV round trip, the shared folder."""

import datetime as dt
import os

import pytest
from pyspark.sql import types as T

from conftest import SF_SMALL
from gridload.plans import queries as Q
from gridload.schemas import interchange_schema
from gridload.session import scratch_path, shared_dir
from gridload.sources import tpch
from gridload.sources.catalog import checked_parquet, load_tables
from gridload.sources.csv import read_interchange
from gridload.sources.sinks import write_csv


def test_read_table_sees_appended_files(spark, workdir):
    path = os.path.join(workdir, "events.parquet")
    spark.range(3).write.parquet(path)
    assert tpch.read_table(spark, workdir, "events").count() == 3
    spark.range(5).write.mode("append").parquet(path)
    assert tpch.read_table(spark, workdir, "events").count() == 8


def test_read_table_keeps_every_column(spark, workdir):
    df = spark.createDataFrame([(1, "ASIA", "new")], "r_regionkey int, r_name string, extra string")
    df.write.parquet(os.path.join(workdir, "region.parquet"))
    assert tpch.read_table(spark, workdir, "region").columns == ["r_regionkey", "r_name", "extra"]


def test_scan_select_all_leaves_no_view_and_keeps_the_callers(spark):
    spark.range(2).createOrReplaceTempView("region")
    before = {t.name for t in spark.catalog.listTables()}
    out = Q.scan_select_all(spark, SF_SMALL)
    assert out.columns == ["n_nationkey", "n_name", "n_regionkey", "r_regionkey", "r_name"]
    assert {t.name for t in spark.catalog.listTables()} == before
    assert spark.table("region").count() == 2
    spark.catalog.dropTempView("region")


def test_parquet_input_is_checked(spark, workdir):
    schema = interchange_schema()
    good = spark.createDataFrame([(dt.datetime(2018, 1, 1), "SE", 1.5)], schema)
    good.write.parquet(os.path.join(workdir, "good"))
    assert checked_parquet(spark, os.path.join(workdir, "good"), schema).collect() == good.collect()
    path = os.path.join(workdir, "misnamed")
    good.withColumnRenamed("valor", "val_intercambio").write.parquet(path)
    with pytest.raises(ValueError, match="val_intercambio"):
        load_tables(spark, [path], ["intercambio"], fmt="parquet", register=False)
    path = os.path.join(workdir, "text")
    good.withColumn("valor", good["valor"].cast("string")).write.parquet(path)
    with pytest.raises(ValueError, match="valor"):
        load_tables(spark, [path], ["intercambio"], fmt="parquet", register=False)
    path = os.path.join(workdir, "whole")
    good.withColumn("valor", good["valor"].cast("int")).write.parquet(path)
    t = load_tables(spark, [path], ["intercambio"], fmt="parquet", register=False)
    assert t["intercambio"].schema["valor"].dataType == T.DoubleType()


class Conf:
    def __init__(self, **values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class Session:
    def __init__(self, **values):
        self.conf = Conf(**{k.replace("__", "."): v for k, v in values.items()})


def test_shared_folder_off_local_mode_must_be_set():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(Session(spark__master=master))
    cluster = Session(spark__master="yarn", spark__checkpoint__dir="hdfs:///shared/")
    assert scratch_path(cluster, "x").startswith("hdfs:///shared/x-")
    local = Session(spark__master="local[4]", spark__app__id="app-1")
    assert shared_dir(local) == shared_dir(local) and os.path.isdir(shared_dir(local))


def test_shared_folder_is_not_registered_as_checkpoint_folder(spark):
    before = spark.sparkContext.getCheckpointDir()
    shared_dir(spark)
    assert spark.sparkContext.getCheckpointDir() == before


def test_csv_round_trip_keeps_instants_and_values(spark, workdir):
    schema = T.StructType([T.StructField("data", T.TimestampType()),
                           T.StructField("subsistema", T.StringType()),
                           T.StructField("valor", T.DoubleType())])
    rows = [(dt.datetime(2018, 1, 27, 0, 0, 0, 123456), "SE", -4560.0474),
            (dt.datetime(2018, 1, 28), None, None), (dt.datetime(2018, 1, 29), "S", float("nan"))]
    df = spark.createDataFrame(rows, schema)
    path = write_csv(df, os.path.join(workdir, "rt"))
    with open([os.path.join(path, f) for f in sorted(os.listdir(path))
               if f.endswith(".csv") and os.path.getsize(os.path.join(path, f)) > 30][0]) as f:
        assert f.readline().strip() == "data;subsistema;valor"
    back = sorted(read_interchange(spark, path).collect(), key=lambda r: r.data)
    assert back[0].data == rows[0][0] and back[0].valor == -4560.0474
    assert back[1].subsistema is None and back[1].valor is None
    assert back[2].valor != back[2].valor  # NaN survives


def test_load_tables_parquet_and_decimal(spark, workdir):
    from decimal import Decimal

    from fixtures import INTERCHANGE_CSV, write
    from gridload.sources.catalog import select_all

    t = load_tables(spark, [f"{SF_SMALL}/region.parquet"], ["regiao"], fmt="parquet")
    assert list(t) == ["regiao"] and select_all(spark, "regiao").count() == 5
    d = load_tables(spark, [write(workdir, "i.csv", INTERCHANGE_CSV)], ["intercambio"],
                    value_type="decimal(18,4)")["intercambio"]
    assert d.schema["valor"].dataType == T.DecimalType(18, 4)
    assert min(r.valor for r in d.collect()) == Decimal("-1300.2500")
    with pytest.raises(ValueError):
        load_tables(spark, ["x"], ["intercambio"], value_type="string")
    with pytest.raises(ValueError):
        load_tables(spark, ["x"], ["intercambio"], fmt="orc")
