"""The registry of runs, and runs that fail, are retried, replaced or published."""

import uuid

import pytest
from pyspark.sql import functions as F

from gridload import DAILY, run_load_job
from gridload.operators import registry as G
from gridload.operators.metrics import metric_rows
from gridload.sources.catalog_tables import drop_catalog_table
from test_jobs import one_sided


def broken(tables):
    return {**tables, "intercambio": tables["intercambio"].withColumn(
        "valor", F.when(F.col("valor") > 0, F.raise_error(F.lit("bad block"))).cast("double"))}


def test_an_attempt_put_twice_is_stored_once(spark, workdir):
    path = f"{workdir}/m"
    assert G.runs(spark, path).count() == 0 and G.next_attempt(spark, path, "12") == 1
    for _ in range(3):
        G.put_attempt(spark, metric_rows("12", "s", {"a": 1, "b": "x"}), path, "12", 1)
    G.put_attempt(spark, metric_rows("0012", "s", {"a": 2}), path, "0012", 1)
    assert sorted((r.run_id, r.metric) for r in G.runs(spark, path).collect()) == [
        ("0012", "a"), ("12", "a"), ("12", "b")]
    assert G.next_attempt(spark, path, "12") == 2 and G.next_attempt(spark, path, "13") == 1
    with pytest.raises(ValueError, match="other runs"):
        G.put_attempt(spark, metric_rows("12", "s", {"a": 1}), path, "13", 1)


def test_a_failed_and_retried_run_gives_one_set_and_a_failed_stage(spark, workdir):
    tables, path = one_sided(spark), f"{workdir}/m"
    args = {"unit": DAILY, "out": f"{workdir}/carga", "mode": "append", "metrics_path": path,
            "run_id": "r1"}
    with pytest.raises(Exception, match="bad block"):
        run_load_job(spark, broken(tables), **args)
    failed = {(r.metric, r.text) for r in G.runs(spark, path).where("stage = 'failed'").collect()}
    assert ("failed_stage", "process_data") in failed
    assert any(m == "error" and "bad block" in t for m, t in failed)
    assert G.run_states(spark, path).collect()[0].asDict() == {
        "run_id": "r1", "attempts": 1, "failed": True}
    res = run_load_job(spark, tables, **args)
    rows = G.runs(spark, path)
    assert rows.where("stage = 'failed'").count() == 0
    counts = rows.where("metric = 'record_count' and stage = 'calculate_carga'").collect()
    assert [r.value for r in counts] == [31.0]
    assert rows.groupBy("stage", "metric").count().where("count > 1").count() == 0
    assert G.run_states(spark, path).collect()[0].asDict() == {
        "run_id": "r1", "attempts": 2, "failed": False}
    assert G.attempts(spark, path).where("stage = 'failed'").count() == 2
    assert spark.read.parquet(f"{workdir}/carga").count() == 31 and res.peak["valor"] == 9.0


def test_replace_changes_one_run_only(spark, workdir):
    tables, out = one_sided(spark), f"{workdir}/carga"
    high = {**tables, "geracao": tables["geracao"].withColumn("valor", F.lit(99.0))}
    for name, t in (("a", tables), ("b", tables), ("a", high)):
        run_load_job(spark, t, unit=DAILY, out=out, mode="replace", run_id=name)
    got = {(r.run_id, r.valor) for r in spark.read.parquet(out).collect()}
    assert got == {("a", 98.0), ("b", 9.0)}
    empty = {**tables, "geracao": tables["geracao"].where("false")}
    res = run_load_job(spark, empty, unit=DAILY, out=out, mode="replace", run_id="a",
                       collect_rows=True)
    assert res.rows == [] and {r.run_id for r in spark.read.parquet(out).collect()} == {"b"}


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_replace_in_both_formats(spark, workdir, fmt):
    tables, out = one_sided(spark), f"{workdir}/carga"
    for _ in range(2):
        res = run_load_job(spark, tables, unit=DAILY, out=out, mode="replace", run_id="a",
                           output_format=fmt, collect_rows=True)
    assert len(res.rows) == 31


def test_published_runs_of_the_job(spark, workdir):
    tables, name = one_sided(spark), f"carga_{uuid.uuid4().hex}"
    args = {"unit": DAILY, "out": f"{workdir}/carga", "table": name}
    run_load_job(spark, tables, run_id="jan", **args)
    run_load_job(spark, tables, run_id="feb", **args)
    with pytest.raises(Exception, match="bad block"):
        run_load_job(spark, broken(tables), run_id="jan", **args)
    high = {**tables, "geracao": tables["geracao"].withColumn("valor", F.lit(99.0))}
    res = run_load_job(spark, high, run_id="feb", collect_rows=True, **args)
    assert len(res.rows) == 31 and res.peak["valor"] == 98.0
    got = spark.table(name).groupBy("run_id").agg(F.count("*").alias("n"), F.max("valor").alias("m"))
    assert {(r.run_id, r.n, r.m) for r in got.collect()} == {("jan", 31, 9.0), ("feb", 31, 98.0)}
    empty = {**tables, "geracao": tables["geracao"].where("false")}
    assert run_load_job(spark, empty, run_id="jan", **args).peak is None
    assert {r.run_id for r in spark.table(name).collect()} == {"feb"}
    with pytest.raises(ValueError, match="parquet"):
        run_load_job(spark, tables, output_format="csv", **args)
    drop_catalog_table(spark, name)
