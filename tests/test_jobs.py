"""End to end: catalog-shaped partitioned sources -> extraction CSV -> load job."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from fixtures import GENERATION_CSV, INTERCHANGE_CSV, LOAD_MONTHLY, RESOURCES_CSV, write
from gridload import DAILY, MONTHLY
from gridload.operators.metrics import STAGE_GENERATION, STAGE_INTERCHANGE, STAGE_LOAD
from gridload.plans.extract_job import run_extract_job
from gridload.plans.load_job import run_load_job
from gridload.sources import extract as X
from gridload.sources.csv import read_generation, read_interchange, read_resources


def catalog(spark, workdir):
    """Write the fixture as partitioned catalog tables (text partitions) plus
    rows every filter must drop."""
    def parts(df, cls):
        return (df.withColumn(X.YEAR_COL, F.year("data").cast("string"))
                  .withColumn(X.MONTH_COL, F.month("data").cast("string"))
                  .withColumn(X.PERIOD_COL, F.lit("DI"))
                  .withColumn(X.CLASS_COL, F.lit(cls)))

    inter = read_interchange(spark, write(workdir, "i.csv", INTERCHANGE_CSV))
    inter = parts(inter, "Consistido").unionByName(parts(inter, "Preliminar"))
    inter = inter.select(F.col("data").alias(X.START_COL), F.col("subsistema").alias(X.SUBSYSTEM_COL),
                         F.col("valor").alias(X.INTERCHANGE_VALUE_COL), X.YEAR_COL, X.MONTH_COL,
                         X.PERIOD_COL, X.CLASS_COL)
    gen = read_generation(spark, write(workdir, "g.csv", GENERATION_CSV))
    gen = parts(gen, "Preliminar").unionByName(parts(gen, "Consistido"))
    gen = gen.select(F.col("data").alias(X.START_COL), F.col("valor").alias(X.GENERATION_VALUE_COL),
                     F.col("id_usina").alias(X.RESOURCE_ID_COL),
                     F.col("guid_usina").alias(X.RESOURCE_GUID_COL), X.YEAR_COL, X.MONTH_COL,
                     X.PERIOD_COL, X.CLASS_COL)
    res = read_resources(spark, write(workdir, "r.csv", RESOURCES_CSV + "5;g5;\n"))
    res = res.select(F.col("id_recurso").alias(X.RESOURCE_ID_COL),
                     F.col("guid_recurso").alias(X.RESOURCE_GUID_COL),
                     F.col("subsistema").alias(X.SUBSYSTEM_COL))
    paths = {}
    for name, df, by in (("i", inter, [X.YEAR_COL, X.MONTH_COL]),
                         ("g", gen, [X.YEAR_COL, X.MONTH_COL]), ("r", res, [])):
        paths[name] = os.path.join(workdir, f"cat_{name}")
        (df.write.partitionBy(*by) if by else df.write).parquet(paths[name])
    read = {k: spark.read.schema(df.schema).parquet(paths[k])
            for k, df in (("i", inter), ("g", gen), ("r", res))}
    return read["i"], read["g"], read["r"]


def extract(spark, workdir):
    i, g, r = catalog(spark, workdir)
    return run_extract_job(spark, i, g, r, 2018, 1, os.path.join(workdir, "extract"))


def test_extract_writes_loader_ready_csv(spark, workdir):
    paths = extract(spark, workdir)
    assert read_interchange(spark, paths["intercambio"]).count() == 13
    gen = read_generation(spark, paths["geracao"])
    assert gen.count() == 7  # February row and the other classification are filtered
    res = read_resources(spark, paths["recursos"])
    assert sorted(r.guid_recurso for r in res.collect()) == ["g1", "g2", "g3", "g4"]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_load_job_daily(spark, workdir, fmt):
    paths = extract(spark, workdir)
    names = ["geracao", "intercambio", "recursos"]
    out = os.path.join(workdir, "carga")
    metrics = os.path.join(workdir, "metrics")
    res = run_load_job(spark, [paths[n] for n in names], names, DAILY, out,
                       metrics_path=metrics, output_format=fmt, collect_rows=True)
    assert res.table_counts == {"geracao": 7, "intercambio": 13, "recursos": 4}
    assert res.peak["subsistema"] == "SE"
    assert res.peak["data"].startswith("2018-01-02")
    assert res.peak["valor"] == 6100.0
    assert res.stages[STAGE_GENERATION]["record_count"] == 4
    assert res.stages[STAGE_INTERCHANGE]["record_count"] == 10
    assert res.stages[STAGE_LOAD]["record_count"] == 4
    assert res.stages[STAGE_LOAD]["max_valor"] == 6100.0
    assert len(res.rows) == 4
    m = spark.read.parquet(metrics)
    stages = {r.stage for r in m.select("stage").distinct().collect()}
    assert {"start_job", "load_data", "initial_data_stats", "aggreg_geracao",
            "aggreg_intercambio", "calculate_carga", "process_data", "convert_data_to_list",
            "end_job"} <= stages
    peak = m.where("metric = 'peak_subsistema'").collect()
    assert [r.text for r in peak] == ["SE"]


def test_load_job_monthly(spark, workdir):
    paths = extract(spark, workdir)
    names = ["geracao", "intercambio", "recursos"]
    res = run_load_job(spark, [paths[n] for n in names], names, MONTHLY,
                       os.path.join(workdir, "carga"), collect_rows=True)
    got = {r[0]: r[1] for r in res.rows}
    assert got == pytest.approx({k: LOAD_MONTHLY[k] for k in ("SE", "S")})
    assert res.peak["subsistema"] == "SE" and "data" not in res.peak


def test_load_job_rejects_bad_arguments(spark, workdir):
    with pytest.raises(ValueError):
        run_load_job(spark, ["a"], ["geracao"], DAILY, os.path.join(workdir, "x"))
    with pytest.raises(ValueError):
        run_load_job(spark, ["a", "b", "c"], ["geracao", "intercambio", "recursos"], "anual",
                     os.path.join(workdir, "x"))


def test_command_lines(spark, workdir):
    from gridload.plans import extract_job, load_job

    i, g, r = catalog(spark, workdir)
    for name, df in (("cat_i_t", i), ("cat_g_t", g), ("cat_r_t", r)):
        df.createOrReplaceTempView(name)
    out = os.path.join(workdir, "cli")
    paths = extract_job.main(["--interchange", "cat_i_t", "--generation", "cat_g_t",
                              "--resources", "cat_r_t", "--year", "2018", "--month", "1",
                              "--out", f"{out}/extract"])
    res = load_job.main(["--datafiles", paths["geracao"], paths["intercambio"], paths["recursos"],
                         "--table_names", "geracao", "intercambio", "recursos",
                         "--aggreg_unit", "diario", "--out", f"{out}/carga",
                         "--metrics", f"{out}/metrics", "--value-type", "decimal(18,4)"])
    assert res.peak["subsistema"] == "SE" and res.peak["valor"] == 6100.0
    assert spark.read.parquet(f"{out}/metrics").where("stage = 'end_job'").count() == 1


def test_load_job_without_profile(spark, workdir):
    paths = extract(spark, workdir)
    names = ["geracao", "intercambio", "recursos"]
    res = run_load_job(spark, [paths[n] for n in names], names, DAILY,
                       os.path.join(workdir, "carga"), profile=False)
    assert res.table_counts == {} and res.peak["valor"] == 6100.0
    assert res.stages[STAGE_LOAD]["record_count"] == 4


def test_classic_command_line_form(spark, workdir, monkeypatch):
    from fixtures import GENERATION_CSV, INTERCHANGE_CSV, RESOURCES_CSV
    from gridload.plans import load_job

    data = os.path.join(workdir, "data")
    os.makedirs(data)
    for name, text in (("geracao", GENERATION_CSV), ("intercambio", INTERCHANGE_CSV),
                       ("recursos", RESOURCES_CSV)):
        write(data, f"{name}.csv", text)
    monkeypatch.chdir(workdir)
    res = load_job.main(["--datafiles", "geracao;intercambio;recursos",
                         "--table_names", "geracao;intercambio;recursos",
                         "--aggreg_unit", "mensal", "--sep", ";", "--collect"])
    assert {r[0]: r[1] for r in res.rows} == pytest.approx(LOAD_MONTHLY)
    assert res.peak["subsistema"] == "SE"


def one_sided(spark, empty_generation=False):
    """Interchange of 7 subsystems x 31 days, generation of SE only."""
    days = [dt.datetime(2018, 1, d) for d in range(1, 32)]
    subs = ["SE", "S", "N", "NE", "AR", "PY", "UY"]
    i = spark.createDataFrame([(d, s, float(k + 1)) for d in days for k, s in enumerate(subs)],
                              "data timestamp, subsistema string, valor double")
    gen = [] if empty_generation else [(d, 10.0, "1", "g1") for d in days]
    g = spark.createDataFrame(gen, "data timestamp, valor double, id_usina string, "
                                   "guid_usina string")
    r = spark.createDataFrame([("1", "g1", "SE")],
                              "id_recurso string, guid_recurso string, subsistema string")
    return {"geracao": g, "intercambio": i, "recursos": r}


@pytest.mark.parametrize("coalesce", ["true", "false"])
@pytest.mark.parametrize("parts", ["8", "200"])
@pytest.mark.parametrize("unit,groups", [(DAILY, 31), (MONTHLY, 1)])
@pytest.mark.parametrize("empty", [False, True])
def test_stage_metrics_count_one_sided_rows(spark, workdir, coalesce, parts, unit, groups, empty):
    """Subsystems on one side only are counted, however the join's partitions
    fall, and also when one side is empty."""
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": coalesce,
            "spark.sql.shuffle.partitions": parts}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        res = run_load_job(spark, one_sided(spark, empty), unit=unit,
                           out=os.path.join(workdir, "carga"), collect_rows=True)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    own = 0 if empty else groups
    assert res.stages[STAGE_INTERCHANGE] == {"record_count": 7 * groups, "max_valor": 7.0}
    assert res.stages[STAGE_GENERATION] == {"record_count": own,
                                            "max_valor": None if empty else 10.0}
    assert res.stages[STAGE_LOAD] == {"record_count": own, "max_valor": None if empty else 9.0}
    assert len(res.rows) == own and (res.peak is None) == empty


def test_appended_runs_report_their_own_peak(spark, workdir):
    out, metrics = os.path.join(workdir, "carga"), os.path.join(workdir, "metrics")
    tables = one_sided(spark)
    high = {**tables, "geracao": tables["geracao"].withColumn("valor", F.lit(99.0))}
    low = {**tables, "geracao": tables["geracao"].withColumn("valor", F.lit(12.0))}
    first = run_load_job(spark, high, unit=DAILY, out=out, mode="append", metrics_path=metrics)
    second = run_load_job(spark, low, unit=DAILY, out=out, mode="append", metrics_path=metrics,
                          collect_rows=True)
    assert (first.peak["valor"], second.peak["valor"]) == (98.0, 11.0)
    assert len(second.rows) == 31
    both = spark.read.parquet(out)
    assert both.count() == 62 and both.select("run_id").distinct().count() == 2
    lists = spark.read.parquet(metrics).where("stage = 'convert_data_to_list'")
    assert [r.value for r in lists.where("metric = 'record_count'").collect()] == [31.0]
    with pytest.raises(ValueError, match="mode"):
        run_load_job(spark, low, unit=DAILY, out=out, mode="ignore")
    with pytest.raises(ValueError, match="already"):
        run_load_job(spark, low, unit=DAILY, out=out, mode="append", run_id=first.run_id)
    with pytest.raises(Exception, match="already exists"):
        run_load_job(spark, low, unit=DAILY, out=out)


def test_failed_collect_keeps_the_metrics(spark, workdir):
    metrics = os.path.join(workdir, "metrics")
    with pytest.raises(ValueError, match="more than 5 rows"):
        run_load_job(spark, one_sided(spark), unit=DAILY, out=os.path.join(workdir, "carga"),
                     metrics_path=metrics, collect_rows=True, max_collect_rows=5)
    stages = {r.stage for r in spark.read.parquet(metrics).collect()}
    assert {"start_job", "aggreg_geracao", "process_data", "end_job"} <= stages


def test_stage_times_rise_and_name_their_tables(spark, workdir):
    metrics = os.path.join(workdir, "metrics")
    tables, start = one_sided(spark), time.time()
    run_load_job(spark, tables, unit=DAILY, out=os.path.join(workdir, "carga"),
                 metrics_path=metrics)
    rows = spark.read.parquet(metrics).collect()
    at = {s: min(r.recorded_at for r in rows if r.stage == s) for s in
          ("start_job", "load_data", "initial_data_stats", "aggreg_geracao", "calculate_carga",
           "process_data", "end_job")}
    times = list(at.values())
    assert times == sorted(times) and len(set(times)) == len(times)
    assert (at["process_data"] - at["load_data"]).total_seconds() > 0.05
    assert (at["end_job"] - at["start_job"]).total_seconds() <= time.time() - start
    named = {r.stage: r.text for r in rows if r.metric == "tablename"}
    assert named == {"aggreg_geracao": "geracao", "aggreg_intercambio": "intercambio"}
    assert any(r.stage == "calculate_carga" and r.metric == "elapsed_s" and r.value > 0
               for r in rows)


def test_load_job_from_parquet(spark, workdir):
    tables, paths = one_sided(spark), {}
    for name, df in tables.items():
        paths[name] = os.path.join(workdir, name)
        df.write.parquet(paths[name])
    res = run_load_job(spark, list(paths.values()), list(paths), MONTHLY,
                       os.path.join(workdir, "carga"), input_format="parquet")
    assert res.peak == {"subsistema": "SE", "valor": 9.0}
    assert res.table_counts == {"geracao": 31, "intercambio": 217, "recursos": 1}


def test_measured_dimension_size_spares_the_check(spark):
    from gridload import aggregate_generation
    from gridload.operators.aggregate import dimension_measures

    t = one_sided(spark)
    assert tuple(dimension_measures(t["recursos"]).collect()[0]) == (1, 4)
    for size in ((1, 4), (10**9, 4), (1, 10**12)):
        out = aggregate_generation(t["geracao"], t["recursos"], MONTHLY, dimension_size=size)
        assert [tuple(r) for r in out.collect()] == [("SE", 10.0)]
