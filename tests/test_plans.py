"""Physical plan shape: pruning, pushdown, shuffles, bounded top-k."""

import os
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF_SMALL
from fixtures import GENERATION_CSV, RESOURCES_CSV, write
from gridload import DAILY, MONTHLY, peak_load, peak_load_per_day, regional_load, top_loads
from gridload.plans import queries as Q
from gridload.sources import tpch
from gridload.sources.csv import read_generation, read_interchange, read_resources
from gridload.sources.extract import extract_generation
from plan_text import plan


def small_tables(spark, workdir):
    i = write(workdir, "i.csv", "data;subsistema;valor\n2018-01-01T00:00:00.000Z;SE;1.0\n"
                                "2018-01-02T00:00:00.000Z;S;2.0\n")
    return (read_generation(spark, write(workdir, "g.csv", GENERATION_CSV)),
            read_interchange(spark, i),
            read_resources(spark, write(workdir, "r.csv", RESOURCES_CSV)))


def plan_simple(df):
    return plan(df, "simple")


def test_daily_join_adds_no_shuffle(spark, workdir):
    g, i, r = small_tables(spark, workdir)
    text = plan_simple(regional_load(g, i, r, DAILY))
    # one exchange per aggregation; the join reuses their partitioning
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 2
    assert "BroadcastHashJoin" in text  # plant dimension, size-checked


def test_large_dimension_preaggregates_before_join(spark, workdir):
    g, i, r = small_tables(spark, workdir)
    text = plan_simple(regional_load(g, i, r, DAILY, broadcast_max_rows=0))
    # generation is first aggregated per (plant, instant), then joined
    assert re.search(r"HashAggregate\(keys=\[guid_usina#\d+, data#\d+\]", text)
    # neither side of the plant join is broadcast on an estimate
    assert re.search(r"SortMergeJoin \[guid_usina#\d+\], \[guid_recurso#\d+\]", text)
    text_m = plan_simple(regional_load(g, i, r, MONTHLY, broadcast_max_rows=0))
    assert re.search(r"HashAggregate\(keys=\[guid_usina#\d+\]", text_m)


def test_scan_reads_only_used_columns(spark):
    text = plan(Q.load_daily(spark, SF_SMALL))
    schemas = re.findall(r"ReadSchema: (struct<[^\n]*>)", text)
    lineitem = [s for s in schemas if "l_shipdate" in s]
    assert lineitem == ["struct<l_suppkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>"]


def test_peak_is_bounded_heap(spark, workdir):
    g, i, r = small_tables(spark, workdir)
    load = regional_load(g, i, r, DAILY)
    assert "TakeOrderedAndProject" in plan_simple(peak_load(load))
    assert "TakeOrderedAndProject" in plan_simple(top_loads(load, 100))


def test_rank_one_filter_is_map_side_limited(spark, workdir):
    g, i, r = small_tables(spark, workdir)
    text = plan_simple(peak_load_per_day(regional_load(g, i, r, DAILY)))
    assert "WindowGroupLimit" in text


def test_partition_pruning_on_text_partitions(spark, workdir):
    src = tpch.generation_source(spark, SF_SMALL)
    path = os.path.join(workdir, "g_part")
    src.write.partitionBy("p_ano", "p_mes").parquet(path)
    schema = T.StructType(src.schema.fields)  # p_ano/p_mes stay text
    df = extract_generation(spark.read.schema(schema).parquet(path), 1998, 1, "A", "F")
    text = plan(df)
    assert re.search(r"PartitionFilters: \[.*\(p_ano#\d+ = 1998\).*\(p_mes#\d+ = 1\)", text)
    assert "EqualTo(cod_periodograndeza,A)" in text and "EqualTo(tip_classificacao,F)" in text
    direct = extract_generation(src, 1998, 1, "A", "F")
    assert sorted(df.collect()) == sorted(direct.collect())


def test_hot_plant_is_split_by_aqe_when_not_broadcast(spark):
    """A plant with most of the rows, joined without broadcast: AQE splits the
    skewed partition of the fact side instead of running it in one task."""
    from pyspark.sql import functions as F

    from gridload import attach_subsystem
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
             "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        ids = spark.range(0, 60000)
        gen = ids.select(F.lit("2018-01-01").cast("timestamp").alias("data"),
                         F.lit(1.0).alias("valor"), F.lit("x").alias("id_usina"),
                         F.when(F.col("id") % 10 < 8, F.lit("hot"))
                          .otherwise((F.col("id") % 500).cast("string")).alias("guid_usina"))
        res = spark.range(0, 500).select(F.col("id").cast("string").alias("id_recurso"),
                                         F.col("id").cast("string").alias("guid_recurso"),
                                         F.lit("S").alias("subsistema")).union(
            spark.createDataFrame([("h", "hot", "SE")], "id_recurso string, "
                                  "guid_recurso string, subsistema string"))
        out = attach_subsystem(gen, res, broadcast_max_rows=0)
        rows = out.groupBy("subsistema").count().collect()
        assert {r.subsistema: r["count"] for r in rows} == {"SE": 48000, "S": 12000}
        assert len(out.collect()) == 60000  # runs out's own plan, so explain shows its final form
        final = plan(out, "simple")
        assert "isFinalPlan=true" in final and "skew=true" in final
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_partition_pruning_when_partitions_inferred_as_numbers(spark, workdir):
    src = tpch.generation_source(spark, SF_SMALL)
    path = os.path.join(workdir, "g_part_inferred")
    src.write.partitionBy("p_ano", "p_mes").parquet(path)
    inferred = spark.read.parquet(path)
    assert dict(inferred.dtypes)["p_ano"] == "int"
    df = extract_generation(inferred, 1998, 1, "A", "F")
    assert "PartitionFilters: [" in plan(df) and "p_mes" in plan(df).split("PartitionFilters: [")[1]
    direct = extract_generation(src, 1998, 1, "A", "F")
    assert sorted(df.collect()) == sorted(direct.collect()) and df.count() > 0


def test_broadcast_check_bounds_rows_and_bytes(spark):
    from pyspark.sql import functions as F

    from gridload.operators.joins import fits_broadcast
    dim = spark.range(1000).select(F.col("id").cast("string").alias("k"),
                                   F.repeat(F.lit("x"), 100).alias("v"))
    assert fits_broadcast(dim)
    assert not fits_broadcast(dim, max_rows=999)
    assert not fits_broadcast(dim, max_bytes=50_000)  # ~103 kB of text
    assert fits_broadcast(dim, max_bytes=200_000)
    assert not fits_broadcast(dim, max_rows=0)


def test_size_check_has_no_single_task_funnel(spark, monkeypatch):
    """The broadcast size check is a plain global aggregate: no limit, whose
    plan would gather rows from every partition into one task."""
    from gridload.operators.joins import fits_broadcast

    df = spark.range(100).toDF("k")
    calls = []
    original = type(df).limit
    monkeypatch.setattr(type(df), "limit", lambda self, n: calls.append(n) or original(self, n))
    assert fits_broadcast(df)
    assert calls == []


def test_registered_extraction_prunes_partitions(spark):
    from gridload.plans.extract_job import extract_frames

    names = Q.partitioned_sources(spark, SF_SMALL)
    frames = extract_frames(spark, *names, Q.EXTRACT_YEAR, Q.EXTRACT_MONTH,
                            period=Q.GENERATION_CODES[0], generation_class=Q.GENERATION_CODES[1])
    text = plan(frames["geracao"])
    assert re.search(r"PartitionFilters: \[.*p_ano#\d+ = 1998\).*p_mes#\d+ = 1\)", text)
    assert "EqualTo(tip_classificacao,F)" in text
    for n in names:
        spark.catalog.dropTempView(n)


def test_positions_have_no_single_partition_window(spark, workdir):
    from gridload import load_positions

    rows = spark.range(0, 5000, 1, 7).select(
        F.lit("S").alias("subsistema"), F.col("id").cast("timestamp").alias("data"),
        (F.col("id") % 97).cast("double").alias("valor"))
    rows = rows.unionByName(spark.createDataFrame(
        [("S", None, None), ("S", None, float("nan"))],
        "subsistema string, data timestamp, valor double"))
    df = load_positions(rows, f"{workdir}/p")
    got = {r.pos: (r.valor, r.data) for r in df.collect()}
    assert sorted(got) == list(range(1, 5003))
    text = plan(df, "formatted")
    assert "Window" not in text and "SinglePartition" not in text
    want = rows.orderBy(F.desc_nulls_last("valor"), "subsistema", "data").collect()
    assert [repr(got[k + 1]) for k in range(5002)] == [repr((r.valor, r.data)) for r in want]
    assert load_positions(rows.limit(0), f"{workdir}/q").collect() == []


def test_footer_profile_reads_no_rows(spark):
    import pytest
    from gridload.operators.profile import footer_profile

    df = footer_profile(spark, {"lineitem": f"{SF_SMALL}/lineitem.parquet"},
                        {"lineitem": ["l_orderkey"]})
    text = plan(df)
    assert "PushedAggregation: [COUNT(*), COUNT(l_orderkey), MIN(l_orderkey), MAX(l_orderkey)]" \
        in text
    assert {r.coluna: r.c for r in df.collect()}[None] == spark.read.parquet(
        f"{SF_SMALL}/lineitem.parquet").count()
    # the caller's session still reads as before
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    with pytest.raises(ValueError, match="no footer statistics"):
        footer_profile(spark, {"lineitem": f"{SF_SMALL}/lineitem.parquet"},
                       {"lineitem": ["l_shipdate"]})
