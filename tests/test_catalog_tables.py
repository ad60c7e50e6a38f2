"""Catalog tables: registered partitions, pruning, buckets, published runs."""

import os
import re
import uuid

import pytest
from pyspark.sql import functions as F

from conftest import SF_ORACLE, SF_SMALL
from gridload import DAILY, compute_load
from gridload.plans import extract_job
from gridload.plans import queries as Q
from gridload.sources import catalog_tables as C
from gridload.sources import extract as X
from gridload.sources import tpch
from plan_text import plan


def fresh(stem="t"):
    return f"{stem}_{uuid.uuid4().hex}"


@pytest.fixture()
def conf(spark):
    before = {}

    def put(key, value):
        before.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, value)

    yield put
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def measurements(spark, name, location, rows=None):
    src = tpch.generation_source(spark, SF_SMALL) if rows is None else rows
    C.create_partitioned(spark, name, src.schema, [X.YEAR_COL, X.MONTH_COL], location)
    C.append_partitions(src, name)
    return src


def test_partitions_are_registered_and_pruned_by_the_catalog(spark, workdir):
    name = fresh()
    src = measurements(spark, name, f"{workdir}/t")
    months = src.select(X.YEAR_COL, X.MONTH_COL).distinct()
    assert sorted(C.partitions(spark, name).collect()) == sorted(months.collect())
    df = X.extract_generation(spark.table(name), 1998, 1, "A", "F")
    assert sorted(df.collect()) == sorted(X.extract_generation(src, 1998, 1, "A", "F").collect())
    text = plan(df)
    assert f"spark_catalog.default.{name}" in text
    assert re.search(r"PartitionFilters: \[.*p_ano#\d+ = 1998\).*p_mes#\d+ = 1\)", text)
    # only the month's folder is listed
    files = spark.table(name).where("p_ano = '1998' and p_mes = '1'").inputFiles()
    assert files and all("/p_ano=1998/p_mes=1/" in f for f in files)
    assert re.search(r"Location: InMemoryFileIndex \[[^,\]]*p_ano=1998/p_mes=1\]", text)
    C.drop_catalog_table(spark, name)
    assert not spark.catalog.tableExists(name) and os.path.isdir(f"{workdir}/t/p_ano=1998")


def test_partitions_from_elsewhere_are_recovered(spark, workdir):
    name, src = fresh(), tpch.generation_source(spark, SF_SMALL)
    where = src.where("p_ano = '1995'")
    where.write.partitionBy(X.YEAR_COL, X.MONTH_COL).parquet(f"{workdir}/t")
    C.create_partitioned(spark, name, src.schema, [X.YEAR_COL, X.MONTH_COL], f"{workdir}/t")
    assert spark.table(name).count() == where.count() > 0
    more = src.where("p_ano = '1996'")
    more.write.partitionBy(X.YEAR_COL, X.MONTH_COL).mode("append").parquet(f"{workdir}/t")
    assert spark.table(name).count() == where.count()  # the catalog does not know them yet
    C.recover_partitions(spark, name)
    assert spark.table(name).count() == where.count() + more.count()
    C.drop_catalog_table(spark, name)


def test_create_again_keeps_rows_and_bad_partitions_raise(spark, workdir):
    name = fresh()
    src = measurements(spark, name, f"{workdir}/it's a folder")
    C.create_partitioned(spark, name, src.schema, [X.YEAR_COL, X.MONTH_COL],
                         f"{workdir}/it's a folder")
    assert spark.table(name).count() == src.count()
    for by in ([], ["nope"]):
        with pytest.raises(ValueError, match="partition columns"):
            C.create_partitioned(spark, fresh(), src.schema, by, f"{workdir}/u")
    C.drop_catalog_table(spark, name)


def test_a_hot_month_is_written_by_several_tasks(spark, workdir, conf):
    for key, value in (("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k"),
                       ("spark.sql.adaptive.rebalancePartitionsSmallPartitionFactor", "0.2")):
        conf(key, value)
    rows = spark.range(0, 60_000, 1, 8).select(
        F.rand(1).alias("v"), F.lit("2018").alias("p_ano"),
        F.when(F.col("id") % 10 < 8, "1").otherwise((F.col("id") % 7 + 2).cast("string"))
        .alias("p_mes"))
    name = fresh()
    C.create_partitioned(spark, name, rows.schema, ["p_ano", "p_mes"], f"{workdir}/t")
    C.append_partitions(rows, name)
    hot = [f for f in os.listdir(f"{workdir}/t/p_ano=2018/p_mes=1") if f.startswith("part-")]
    assert len(hot) > 3 and spark.table(name).count() == 60_000
    C.drop_catalog_table(spark, name)


def test_several_periods_prune_the_scan_at_run_time(spark, workdir):
    name = fresh()
    src = measurements(spark, name, f"{workdir}/t")
    wanted = spark.createDataFrame([(1995, 3), (1994, 11), (1995, 3), (None, 1), (1990, 1)],
                                   "year int, month int")
    df = X.extract_generation(spark.table(name), None, None, "A", "F", periods=wanted)
    want = X.extract_generation(
        src.where("(p_ano, p_mes) in (('1995', '3'), ('1994', '11'))"), 1995, 3, "A", "F"
    ).unionByName(X.extract_generation(src, 1994, 11, "A", "F"))
    assert sorted(df.collect()) == sorted(want.collect()) and want.count() > 0
    text = plan(df, "formatted")
    assert "dynamicpruningexpression(p_ano" in text, text
    assert "dynamicpruningexpression(true)" not in text
    # zero-padded text names the same months
    padded = spark.createDataFrame([("1995", "03"), ("1994", "11")], "y string, m string")
    same = X.extract_generation(spark.table(name), None, None, "A", "F", periods=padded)
    assert sorted(same.collect()) == sorted(want.collect())
    C.drop_catalog_table(spark, name)


def test_extract_job_command_line_takes_periods(spark, workdir):
    names = Q.partitioned_sources(spark, SF_SMALL)
    Q.wanted_periods(spark, SF_SMALL).createOrReplaceTempView("wanted_periods_t")
    paths = extract_job.main(["--interchange", names[0], "--generation", names[1],
                              "--resources", names[2], "--periods", "wanted_periods_t",
                              "--out", f"{workdir}/out"])
    assert sorted(paths) == ["geracao", "intercambio", "recursos"]
    with pytest.raises(SystemExit):
        extract_job.main(["--interchange", "a", "--generation", "b", "--resources", "c",
                          "--out", "d", "--year", "1995"])


def test_registered_periods_read_through_dynamic_pruning(spark):
    names = Q.partitioned_sources(spark, SF_ORACLE)
    frames = extract_job.extract_frames(spark, *names, None, None, period="A",
                                        generation_class="F",
                                        periods=Q.wanted_periods(spark, SF_ORACLE))
    df = frames["geracao"]
    df.collect()
    text = plan(df, "formatted")
    assert "dynamicpruningexpression(p_ano" in text
    for n in names:
        C.drop_catalog_table(spark, n)


def test_bucketed_join_has_no_exchange(spark):
    df = Q.load_daily_bucketed(spark, SF_ORACLE)
    rows = sorted(df.collect())
    text = plan(df, "simple")
    assert "Exchange" not in text and "SortMergeJoin" in text and "Bucketed: true" in text
    assert rows == sorted(Q.load_daily(spark, SF_ORACLE).collect())


def test_each_bucket_is_one_file(spark, workdir):
    name = fresh()
    df = spark.range(1000).select(F.col("id").cast("string").alias("subsistema"),
                                  F.lit(1).alias("data"), F.lit(1.0).alias("valor"))
    C.write_bucketed(df, name, ["subsistema", "data"], 4, f"{workdir}/b")
    assert len([f for f in os.listdir(f"{workdir}/b") if f.startswith("part-")]) == 4
    assert compute_load(spark.table(name), spark.table(name), DAILY).count() == 1000
    with pytest.raises(ValueError, match="positive"):
        C.write_bucketed(df, fresh(), ["data"], 0, f"{workdir}/c")
    C.drop_catalog_table(spark, name)


def run_frame(spark, *values):
    return spark.createDataFrame([(v, float(v)) for v in values], "k int, valor double")


def rows_of(df):
    return sorted((r.run_id, r.k) for r in df.collect())


def test_publish_replaces_one_run_at_once(spark, workdir):
    name, base = fresh(), f"{workdir}/p"
    first = C.publish_run(run_frame(spark, 1, 2), name, "a", base)
    C.publish_run(run_frame(spark, 7), name, "00012", base)
    reader = spark.table(name)
    assert rows_of(reader) == [("00012", 7), ("a", 1), ("a", 2)]
    second = C.publish_run(run_frame(spark, 3), name, "a", base)
    assert rows_of(spark.table(name)) == [("00012", 7), ("a", 3)]
    # a reader that planned before sees old rows, whole, or new rows, whole
    assert rows_of(reader) in ([("00012", 7), ("a", 1), ("a", 2)], [("00012", 7), ("a", 3)])
    assert C.published_folder(spark, name, "a").endswith(second.rsplit("/", 1)[-1])
    assert [f.rsplit("/", 1)[-1] for f in C.stale_folders(spark, name, "a", base)] == [
        first.rsplit("/", 1)[-1]]
    C.drop_catalog_table(spark, name)


def test_a_reader_during_the_write_sees_old_rows(spark, workdir):
    """The table is read while the new rows are half written."""
    name, base, seen = fresh(), f"{workdir}/p", []
    C.publish_run(run_frame(spark, 1), name, "a", base)
    new = run_frame(spark, 5)
    original = type(new.write).parquet

    def watched(writer, path, *args, **kw):
        original(writer, path, *args, **kw)  # the files are there, the switch is not
        seen.append(rows_of(spark.table(name)))

    type(new.write).parquet = watched
    try:
        C.publish_run(new, name, "a", base)
    finally:
        type(new.write).parquet = original
    assert seen == [[("a", 1)]] and rows_of(spark.table(name)) == [("a", 5)]
    C.drop_catalog_table(spark, name)


def test_a_failed_publication_is_never_seen(spark, workdir):
    name, base = fresh(), f"{workdir}/p"
    C.publish_run(run_frame(spark, 1), name, "a", base)
    broken = run_frame(spark, 2).withColumn(
        "valor", F.raise_error(F.lit("no value")).cast("double"))
    with pytest.raises(Exception, match="no value"):
        C.publish_run(broken, name, "a", base)
    with pytest.raises(ValueError, match="has columns"):
        C.publish_run(run_frame(spark, 2).withColumn("other", F.lit(1)), name, "a", base)
    assert rows_of(spark.table(name)) == [("a", 1)]
    C.drop_catalog_table(spark, name)
