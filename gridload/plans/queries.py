"""The registered queries: each operator run over the driver's whole tables.

Every function takes ``(spark, sf_dir)`` and returns a lazy DataFrame built
with the library's operators (the round-trip query writes, then returns the
frame read back). The equivalent SQL for each lives in ``oracle.py``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.casts import cast_string, cast_timestamp
from ..operators.aggregate import aggregate_generation, aggregate_interchange, attach_subsystem
from ..operators.load import compute_load, regional_load
from ..operators.metrics import MAX_VALUE, RECORD_COUNT, STAGE, load_stage_summary
from ..operators.profile import footer_profile, table_counts, table_schemas
from ..operators.rank import (load_positions, order_load, peak_load, peak_load_per_day,
                              top_loads)
from ..operators.registry import runs
from ..operators.state import LoadState
from ..schemas import (DAILY, DATA, GENERATION, INTERCHANGE, MONTHLY, PLANT_GUID,
                       RESOURCE_GUID, RESOURCE_ID, RESOURCES, SUBSYSTEM, VALUE,
                       interchange_schema)
from ..session import scratch_path
from ..sources import extract as X
from ..sources import tpch
from ..sources.catalog import drop_table, load_tables, select_all
from ..sources.catalog_tables import (append_partitions, create_partitioned,
                                      drop_catalog_table, publish_run, write_bucketed)
from ..sources.csv import read_generation, read_interchange, read_resources
from ..sources.quarantine import COLUMN, LINE, REASON, read_quarantined
from ..sources.sinks import to_rows, write_csv
from .extract_job import run_extract_job
from .load_job import run_load_job

# The period the extraction queries select and the codes that
# stand for the period and classification filters in the test mapping.
EXTRACT_YEAR = 1998
EXTRACT_MONTH = 1
INTERCHANGE_CODES = ("F", "1-URGENT")
GENERATION_CODES = ("A", "F")
PROFILED_TABLES = ("lineitem", "orders", "supplier")
TOP_N = 100


def _gen_aggr(spark, sf_dir, unit):
    return aggregate_generation(tpch.generation(spark, sf_dir), tpch.resources(spark, sf_dir),
                                unit)


def _inter_aggr(spark, sf_dir, unit):
    return aggregate_interchange(tpch.interchange(spark, sf_dir), unit)


def _load(spark, sf_dir, unit):
    t = tpch.domain_tables(spark, sf_dir)
    return regional_load(t["geracao"], t["intercambio"], t["recursos"], unit)


def generation_with_subsystem(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = attach_subsystem(tpch.generation(spark, sf_dir), tpch.resources(spark, sf_dir))
    return g.select(SUBSYSTEM, DATA, F.col(PLANT_GUID).cast("string").alias(PLANT_GUID),
                    F.col(VALUE).cast("double").alias(VALUE))


def generation_daily(spark, sf_dir):
    return _gen_aggr(spark, sf_dir, DAILY)


def generation_monthly(spark, sf_dir):
    return _gen_aggr(spark, sf_dir, MONTHLY)


def interchange_daily(spark, sf_dir):
    return _inter_aggr(spark, sf_dir, DAILY)


def interchange_monthly(spark, sf_dir):
    return _inter_aggr(spark, sf_dir, MONTHLY)


def load_daily(spark, sf_dir):
    return _load(spark, sf_dir, DAILY)


def load_monthly(spark, sf_dir):
    return _load(spark, sf_dir, MONTHLY)


def load_daily_large_dimension(spark, sf_dir):
    """The daily load on the path taken when the plant dimension is over the
    broadcast bound: generation pre-aggregated per (plant, instant), then
    shuffle-joined to the dimension."""
    t = tpch.domain_tables(spark, sf_dir)
    return regional_load(t["geracao"], t["intercambio"], t["recursos"], DAILY,
                         broadcast_max_rows=0)


def load_ranked(spark, sf_dir):
    """The whole load, highest first."""
    return order_load(_load(spark, sf_dir, DAILY))


def load_top_n(spark, sf_dir):
    """The ``TOP_N`` highest loads with their positions."""
    return top_loads(_load(spark, sf_dir, DAILY), TOP_N, position="pos")


def peak_load_daily(spark, sf_dir):
    return peak_load(_load(spark, sf_dir, DAILY))


def peak_load_monthly(spark, sf_dir):
    return peak_load(_load(spark, sf_dir, MONTHLY))


def peak_load_per_day_q(spark, sf_dir):
    return peak_load_per_day(_load(spark, sf_dir, DAILY))


def extract_interchange(spark, sf_dir):
    return X.extract_interchange(tpch.interchange_source(spark, sf_dir), EXTRACT_YEAR,
                                 EXTRACT_MONTH, *INTERCHANGE_CODES)


def extract_generation(spark, sf_dir):
    return X.extract_generation(tpch.generation_source(spark, sf_dir), EXTRACT_YEAR,
                                EXTRACT_MONTH, *GENERATION_CODES)


def extract_resources(spark, sf_dir):
    return X.extract_resources(tpch.resources_source(spark, sf_dir))


def sink_csv_roundtrip(spark, sf_dir):
    """Write ``orders`` as interchange-shaped ``;`` CSV under the shared folder,
    then read it back with the typed, header-checked reader."""
    o = tpch.read_table(spark, sf_dir, "orders")
    df = o.select(o.o_orderdate.alias(DATA), o.o_orderpriority.alias(SUBSYSTEM),
                  o.o_totalprice.alias(VALUE))
    path = write_csv(df, scratch_path(spark, "roundtrip-csv"))
    return read_interchange(spark, path, ntz=True)


def scan_select_all(spark, sf_dir):
    """Load several tables by name through the multi-table loader, then read
    two of them back whole by those names: every nation with its region, all
    columns of both. The views have a name of their own and are dropped."""
    base, prefix = sf_dir.rstrip("/"), f"scan_{uuid.uuid4().hex}_"
    names = ["region", "nation", "supplier"]
    load_tables(spark, [f"{base}/{n}.parquet" for n in names], names, fmt="parquet",
                prefix=prefix)
    nation, region = select_all(spark, f"{prefix}nation"), select_all(spark, f"{prefix}region")
    out = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    for n in names:
        drop_table(spark, f"{prefix}{n}")
    return out


def _run_job(spark, sf_dir, base):
    return run_load_job(spark, tpch.domain_tables(spark, sf_dir), unit=DAILY, out=f"{base}/carga",
                        metrics_path=f"{base}/metrics")


def load_job_daily(spark, sf_dir):
    """The whole load job over the mapped tables: profile, load with observed
    stage metrics, one write, peak and metrics table. Returns the load of that
    run, read back."""
    return spark.read.parquet(_run_job(spark, sf_dir, scratch_path(spark, "load-job")).output)


def _stage_numbers(rows, measure):
    """Record count and highest value of each stage that counts records."""
    wide = rows.groupBy(STAGE).agg(*[
        measure(F.when(F.col("metric") == m, F.col("value"))).alias(m)
        for m in (RECORD_COUNT, MAX_VALUE)])
    return (wide.where(F.col(RECORD_COUNT).isNotNull())
            .select(STAGE, F.col(RECORD_COUNT).cast("bigint").alias(RECORD_COUNT), MAX_VALUE))


def load_job_metrics(spark, sf_dir):
    """The stage metrics that the load job wrote, read back from its table."""
    base = scratch_path(spark, "load-job")
    run = _run_job(spark, sf_dir, base)
    rows = spark.read.parquet(f"{base}/metrics").where(F.col("run_id") == run.run_id)
    return _stage_numbers(rows, F.max)


def load_job_retried(spark, sf_dir):
    """The stage metrics of a run whose first attempt failed in the write of the
    load and that was then run again: the registry's one set of rows."""
    base, tables = scratch_path(spark, "load-job"), tpch.domain_tables(spark, sf_dir)
    broken = tables["intercambio"].withColumn(VALUE, F.when(
        F.col(VALUE).isNotNull(), F.raise_error(F.lit("unreadable"))).cast(tpch.VALUE_TYPE))
    args = {"unit": DAILY, "out": f"{base}/carga", "metrics_path": f"{base}/metrics",
            "mode": "append", "run_id": "retried"}
    try:
        run_load_job(spark, {**tables, "intercambio": broken}, **args)
    except Exception as error:
        if "unreadable" not in str(error):
            raise
    run_load_job(spark, tables, **args)
    # a sum, so a row that is there twice would show
    return _stage_numbers(runs(spark, f"{base}/metrics"), F.sum)


def load_rows(spark, sf_dir):
    """The monthly load collected as a list of lists, as a frame again, with
    the place in the list (one row a subsystem, so it fits the driver)."""
    listed = to_rows(order_load(_load(spark, sf_dir, MONTHLY)))
    return spark.createDataFrame([[k, *row] for k, row in enumerate(listed, 1)],
                                 "linha bigint, subsistema string, valor double")


def load_job_csv(spark, sf_dir):
    """The load job end to end on text: the mapped tables as ``;`` CSV,
    header-checked typed read with DECIMAL measures, load."""
    base = scratch_path(spark, "load-job-csv")
    names = [GENERATION, INTERCHANGE, RESOURCES]
    tables = tpch.domain_tables(spark, sf_dir)
    paths = [write_csv(tables[n], f"{base}/input/{n}") for n in names]
    result = run_load_job(spark, paths, names, DAILY, f"{base}/carga", ntz=True,
                          value_type=tpch.VALUE_TYPE)
    return spark.read.parquet(result.output)


def partitioned_sources(spark, sf_dir) -> tuple[str, str, str]:
    """Names of the three source tables in the session catalog: the measurements
    partitioned by year and month, partitions registered, and the plants."""
    base, tag = scratch_path(spark, "catalog"), uuid.uuid4().hex
    names = []
    for name, df in (("interchange", tpch.interchange_source(spark, sf_dir)),
                     ("generation", tpch.generation_source(spark, sf_dir))):
        table = create_partitioned(spark, f"{name}_{tag}", df.schema, [X.YEAR_COL, X.MONTH_COL],
                                   f"{base}/{name}")
        append_partitions(df, table)
        names.append(table)
    plants = tpch.resources_source(spark, sf_dir)
    plants.write.option("path", f"{base}/plants").saveAsTable(f"plants_{tag}")
    return names[0], names[1], f"plants_{tag}"


def _run_extract(spark, sf_dir, year=EXTRACT_YEAR, month=EXTRACT_MONTH, periods=None):
    """The extraction job over catalog tables by name; returns its CSV paths."""
    names = partitioned_sources(spark, sf_dir)
    paths = run_extract_job(spark, *names, year, month, scratch_path(spark, "extract"),
                            period=GENERATION_CODES[0], generation_class=GENERATION_CODES[1],
                            interchange_class=INTERCHANGE_CODES[1], periods=periods)
    for n in names:
        drop_catalog_table(spark, n)
    return paths


def extract_job_generation(spark, sf_dir):
    """The extraction job over catalog tables by name, partitioned by year and
    month: the generation extract of one month, read back from its CSV."""
    return read_generation(spark, _run_extract(spark, sf_dir)[GENERATION], ntz=True)


def extract_job_interchange(spark, sf_dir):
    """The same job with the interchange's period code: its interchange extract."""
    names = partitioned_sources(spark, sf_dir)
    paths = run_extract_job(spark, *names, EXTRACT_YEAR, EXTRACT_MONTH,
                            scratch_path(spark, "extract"), period=INTERCHANGE_CODES[0],
                            interchange_class=INTERCHANGE_CODES[1],
                            generation_class=GENERATION_CODES[1])
    for n in names:
        drop_catalog_table(spark, n)
    return read_interchange(spark, paths[INTERCHANGE], ntz=True)


def extract_job_resources(spark, sf_dir):
    """The plants the extraction job wrote."""
    return read_resources(spark, _run_extract(spark, sf_dir)[RESOURCES])


def wanted_periods(spark, sf_dir):
    """The months of 1995 in which an order is still open in part."""
    o = tpch.read_table(spark, sf_dir, "orders")
    return o.where((F.year("o_orderdate") == 1995) & (F.col("o_orderstatus") == "P")).select(
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))


def extract_job_periods(spark, sf_dir):
    """The extraction job over several months at once, named by the rows of a
    table: the generation extract."""
    paths = _run_extract(spark, sf_dir, None, None, periods=wanted_periods(spark, sf_dir))
    return read_generation(spark, paths[GENERATION], ntz=True)


def load_daily_bucketed(spark, sf_dir):
    """The daily load from its two aggregates as bucketed catalog tables: the
    join needs no shuffle."""
    base, tag = scratch_path(spark, "bucketed"), uuid.uuid4().hex
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sides = []
    for name, aggr in (("generation", _gen_aggr), ("interchange", _inter_aggr)):
        table = write_bucketed(aggr(spark, sf_dir, DAILY), f"{name}_daily_{tag}",
                               [SUBSYSTEM, DATA], buckets, f"{base}/{name}")
        sides.append(spark.table(table))
    return compute_load(*sides, DAILY)


def load_published(spark, sf_dir):
    """The daily load as the table of published runs shows it: a run first
    published with half of its rows and then replaced, beside another run."""
    base, name = scratch_path(spark, "published"), f"carga_{uuid.uuid4().hex}"
    load = _load(spark, sf_dir, DAILY)
    publish_run(load.where(F.col(VALUE) > 0), name, "run-1", base)
    publish_run(load.where(F.col(VALUE) <= 0), name, "run-2", base)
    publish_run(load, name, "run-1", base)
    return spark.table(name).where("run_id = 'run-1'").drop("run_id")


def load_positions_q(spark, sf_dir):
    """Every row of the daily load with its position in the whole order."""
    return load_positions(_load(spark, sf_dir, DAILY), scratch_path(spark, "positions"))


def _load_incremental(spark, sf_dir, unit):
    """The load from states that arrived year by year, the latest year first; one
    year is first delivered in part and then again."""
    t = tpch.domain_tables(spark, sf_dir)
    state = LoadState(spark, scratch_path(spark, "load-state"))

    def rows(name, year):
        return t[name].where(F.year(DATA) == year)

    both = t["geracao"].select(DATA).unionByName(t["intercambio"].select(DATA))
    years = sorted((r[0] for r in both.select(F.year(DATA)).distinct().collect()), reverse=True)
    for k, year in enumerate(years):
        generation, interchange = rows("geracao", year), rows("intercambio", year)
        if k == 0:
            early = F.month(DATA) <= 6
            state.add(generation.where(early), interchange.where(early), t["recursos"], str(year))
        state.add(generation, interchange, t["recursos"], str(year))
    return state.load(unit)


def load_daily_incremental(spark, sf_dir):
    return _load_incremental(spark, sf_dir, DAILY)


def load_monthly_incremental(spark, sf_dir):
    return _load_incremental(spark, sf_dir, MONTHLY)


def table_footers(spark, sf_dir):
    """Rows of the profiled tables and the bounds of some columns, from the
    footers of their files alone."""
    base = sf_dir.rstrip("/")
    return footer_profile(spark, {n: f"{base}/{n}.parquet" for n in PROFILED_TABLES},
                          {"lineitem": ["l_orderkey", "l_suppkey"], "supplier": ["s_suppkey"],
                           "orders": ["o_custkey"]})


def damaged_interchange(spark, sf_dir):
    """Path of the orders as interchange CSV, some lines damaged on purpose: a
    value or an instant that is none, a field too many or too few."""
    o = tpch.read_table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    data = F.when(key % 89 == 0, "soon").otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    value = F.when(key % 97 == 0, "n/a").otherwise(
        F.format_string("%.2f", F.col("o_totalprice").cast("double")))
    line = F.concat_ws(";", data, F.col("o_orderpriority"), value)
    line = F.when(key % 83 == 0, F.concat(line, F.lit(";more"))).when(
        key % 79 == 0, F.substring_index(line, ";", 2)).otherwise(line)
    path = scratch_path(spark, "damaged-csv")
    o.select(line.alias("data;subsistema;valor")).write.option("header", True).option(
        "quote", "\x00").option("sep", "\x01").csv(path)
    return path


def quarantine_lines(spark, sf_dir):
    """The lines that the quarantining reader sets aside, with reason and column."""
    schema = interchange_schema(ntz=True)
    found = read_quarantined(spark, damaged_interchange(spark, sf_dir), schema)
    return found.bad.select(REASON, COLUMN, LINE)


def quarantine_counts(spark, sf_dir):
    """Good rows of the same file by subsystem, with their sum, and the bad lines
    as one row with a null subsystem: together all lines."""
    schema = interchange_schema(ntz=True, value_type=tpch.VALUE_TYPE)
    found = read_quarantined(spark, damaged_interchange(spark, sf_dir), schema)
    good = found.good.groupBy(SUBSYSTEM).agg(F.count(F.lit(1)).alias("c"),
                                             F.sum(VALUE).cast("double").alias(VALUE))
    bad = found.bad.agg(F.count(F.lit(1)).alias("c")).select(
        F.lit(None).cast("string").alias(SUBSYSTEM), "c", F.lit(None).cast("double").alias(VALUE))
    return good.unionByName(bad)


def cast_timestamp_q(spark, sf_dir):
    ev = tpch.read_table(spark, sf_dir, "events")
    as_text = ev.select("event_id", F.col("ts").cast("string").alias("ts"))
    return cast_timestamp(as_text, "ts", ntz=True)


def cast_string_q(spark, sf_dir):
    s = tpch.read_table(spark, sf_dir, "supplier")
    df = s.select(s.s_suppkey.alias(RESOURCE_GUID), s.s_nationkey.alias(RESOURCE_ID))
    return cast_string(cast_string(df, RESOURCE_GUID), RESOURCE_ID)


def _profiled(spark, sf_dir):
    return {name: tpch.read_table(spark, sf_dir, name) for name in PROFILED_TABLES}


def table_counts_q(spark, sf_dir):
    return table_counts(_profiled(spark, sf_dir))


def table_schemas_q(spark, sf_dir):
    return table_schemas(_profiled(spark, sf_dir))


def stage_metrics(spark, sf_dir):
    t = tpch.domain_tables(spark, sf_dir)
    g = aggregate_generation(t["geracao"], t["recursos"], DAILY)
    i = aggregate_interchange(t["intercambio"], DAILY)
    return load_stage_summary(g, i, DAILY)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "generation_with_subsystem": generation_with_subsystem,
    "generation_daily": generation_daily,
    "generation_monthly": generation_monthly,
    "interchange_daily": interchange_daily,
    "interchange_monthly": interchange_monthly,
    "load_daily": load_daily,
    "load_monthly": load_monthly,
    "load_daily_large_dimension": load_daily_large_dimension,
    "load_ranked": load_ranked,
    "load_top_n": load_top_n,
    "load_positions": load_positions_q,
    "load_daily_incremental": load_daily_incremental,
    "load_monthly_incremental": load_monthly_incremental,
    "quarantine_lines": quarantine_lines,
    "quarantine_counts": quarantine_counts,
    "table_footers": table_footers,
    "peak_load_daily": peak_load_daily,
    "peak_load_monthly": peak_load_monthly,
    "peak_load_per_day": peak_load_per_day_q,
    "extract_interchange": extract_interchange,
    "extract_generation": extract_generation,
    "extract_resources": extract_resources,
    "sink_csv_roundtrip": sink_csv_roundtrip,
    "scan_select_all": scan_select_all,
    "cast_timestamp": cast_timestamp_q,
    "cast_string": cast_string_q,
    "table_counts": table_counts_q,
    "table_schemas": table_schemas_q,
    "stage_metrics": stage_metrics,
    "load_job_daily": load_job_daily,
    "load_job_metrics": load_job_metrics,
    "load_job_csv": load_job_csv,
    "load_job_retried": load_job_retried,
    "load_rows": load_rows,
    "extract_job_generation": extract_job_generation,
    "extract_job_interchange": extract_job_interchange,
    "extract_job_resources": extract_job_resources,
    "extract_job_periods": extract_job_periods,
    "load_daily_bucketed": load_daily_bucketed,
    "load_published": load_published,
}


def main(argv: list[str] | None = None) -> None:
    """Print a registered query's physical plan (the final adaptive plan with
    ``--run``)::

        python -m gridload.plans.queries load_daily /root/testdata/sf0.1 --run
    """
    import argparse

    from ..session import build_session

    p = argparse.ArgumentParser(description="Show the physical plan of a registered query")
    p.add_argument("name", choices=sorted(QUERIES))
    p.add_argument("sf_dir", nargs="?", default="/root/testdata/sf0.01")
    p.add_argument("--run", action="store_true", help="execute first, then show the final plan")
    p.add_argument("--master", default="local[*]")
    a = p.parse_args(argv)
    df = QUERIES[a.name](build_session(a.master), a.sf_dir)
    if a.run:
        df.collect()
    df.explain(mode="formatted")


if __name__ == "__main__":
    main()
