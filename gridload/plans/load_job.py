"""The load job: read the three tables, profile them, compute the regional
load, write it, find its peak, and record per-stage metrics.

Input is CSV or Parquet files, or DataFrames. Actions, in order (everything
else is lazy):

1. CSV: one header line per input file (schema check on the driver);
2. one job counting every table (``initial_data_stats``) and measuring the
   plant dimension, so the broadcast check needs no job of its own. For CSV
   input this is a second read of the data (for Parquet, footers and the
   dimension's two columns); ``profile=False`` skips it;
3. one write of the load, which also fills the metrics of the generation
   aggregate, the interchange aggregate and the load (see
   :mod:`gridload.operators.metrics`); no aggregate is evaluated twice;
4. the peak, read back from the rows this run wrote (a bounded top-1; the
   written table also cuts the lineage);
5. the metric rows to the registry (:mod:`gridload.operators.registry`), when a
   path is given, also when the job fails: then with a ``failed`` stage that
   names the stage and the error. Rows are stamped when their stage ends, and
   are stored by run and attempt, so a retried run leaves one set for each.

A run writes the partition ``run_id=...`` of the output and reads that only, so
runs may be appended to one output, and ``mode="replace"`` replaces this run's
rows and no others. With ``table`` the rows are published: written aside and
switched to in the session catalog at once
(:func:`gridload.sources.catalog_tables.publish_run`). The join, the subtraction and both
aggregates are one plan: ``elapsed_s`` of ``calculate_carga`` is the time of
the write that runs it.

Command line::

    python -m gridload.plans.load_job --datafiles g.csv i.csv r.csv \
        --table_names geracao intercambio recursos --aggreg_unit diario \
        --sep ';' --out /shared/carga --metrics /shared/metrics

List values may also be given ``;``-joined, and a bare name (no folder, no
extension) is read from ``<data-dir>/<name>.csv``, so the classic form works
as is::

    python -m gridload.plans.load_job --datafiles "geracao;intercambio;recursos" \
        --table_names "geracao;intercambio;recursos" --aggreg_unit diario --sep ";"
"""

from __future__ import annotations

import argparse
import json
import os
import re
import time
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregate import (aggregate_generation, aggregate_interchange,
                                   dimension_measures)
from ..operators.joins import DEFAULT_BROADCAST_MAX_BYTES, DEFAULT_BROADCAST_MAX_ROWS
from ..operators.metrics import (MAX_VALUE, RECORD_COUNT, STAGE_END,
                                 STAGE_GENERATION, STAGE_INITIAL_STATS, STAGE_INTERCHANGE,
                                 STAGE_LOAD, STAGE_LOAD_DATA, STAGE_PROCESS, STAGE_START,
                                 STAGE_TO_LIST, metric_rows, observed_load, stage_values)
from ..operators.profile import COUNT, TABLE, schema_json, table_counts
from ..operators.rank import peak_load
from ..operators.registry import STAGE_FAILED, next_attempt, put_attempt
from ..schemas import DATA, GENERATION, INTERCHANGE, RESOURCES, SUBSYSTEM, VALUE, check_unit
from ..session import job_description
from ..sources.catalog import load_tables
from ..sources.catalog_tables import publish_run
from ..sources.files import delete_folder, path_exists
from ..sources.sinks import to_rows, write_csv, write_parquet

RUN_ID = "run_id"
MODES = ("errorifexists", "error", "append", "overwrite", "replace")
# The table each aggregate stage reads.
STAGE_TABLES = {STAGE_GENERATION: GENERATION, STAGE_INTERCHANGE: INTERCHANGE}
_DIMENSION = "_dimension"


@dataclass
class LoadJobResult:
    run_id: str
    unit: str
    output: str
    table_counts: dict[str, int]
    stages: dict[str, dict] = field(default_factory=dict)
    peak: dict | None = None
    rows: list[list] | None = None
    elapsed: dict[str, float] = field(default_factory=dict)


def _profile(tables: dict[str, DataFrame]) -> tuple[dict[str, int], tuple[int, int]]:
    """Counts of all tables, and the plant dimension's rows and bytes: one job."""
    size = dimension_measures(tables[RESOURCES])
    parts = [table_counts(tables).withColumn("b", F.lit(0).cast("bigint")),
             size.select(F.lit(_DIMENSION).alias(TABLE), F.col("n").alias(COUNT), "b")]
    rows = {r[TABLE]: r for r in reduce(DataFrame.unionByName, parts).collect()}
    dimension = rows.pop(_DIMENSION)
    return {name: r[COUNT] for name, r in rows.items()}, (dimension[COUNT], dimension["b"])


def _write_run(spark, load, run_id, out, sep, output_format, mode, table, seen):
    """Writes the load as this run's partition of ``out``; returns its path and
    the rows read back from it alone."""
    if table:
        path = publish_run(load, table, run_id, out)
        return path, spark.read.schema(load.schema).parquet(path)
    marked = load.withColumn(RUN_ID, F.lit(run_id))
    path = f"{out.rstrip('/')}/{RUN_ID}={run_id}"
    only_run = mode == "replace"
    write_mode = "overwrite" if only_run else mode
    if output_format == "parquet":
        write_parquet(marked, out, mode=write_mode, partition_by=[RUN_ID], only_partitions=only_run)
        reader = spark.read.schema(load.schema)
    else:
        write_csv(marked, out, sep=sep, mode=write_mode, partition_by=[RUN_ID],
                  only_partitions=only_run)
        reader = spark.read.schema(load.schema).option("sep", sep).option("header", True)
    if only_run and stage_values(seen)[STAGE_LOAD][RECORD_COUNT] == 0:
        delete_folder(spark, path)  # rows of before are replaced by none
    if not path_exists(spark, path):  # an empty load makes no partition
        return path, spark.createDataFrame([], load.schema)
    return path, reader.parquet(path) if output_format == "parquet" else reader.csv(path)


def run_load_job(spark: SparkSession, datafiles: list[str] | dict[str, DataFrame],
                 table_names: list[str] | None = None,
                 unit: str = "", out: str = "", sep: str = ";", metrics_path: str | None = None,
                 output_format: str = "parquet", mode: str = "errorifexists",
                 collect_rows: bool = False, run_id: str | None = None,
                 broadcast_max_rows: int | None = DEFAULT_BROADCAST_MAX_ROWS, ntz: bool = False,
                 value_type: str = "double",
                 broadcast_max_bytes: int = DEFAULT_BROADCAST_MAX_BYTES,
                 profile: bool = True, input_format: str = "csv",
                 max_collect_rows: int | None = None, table: str | None = None) -> LoadJobResult:
    """Run the whole job; see the module docstring.

    ``datafiles`` are paths of ``input_format`` (``csv`` or ``parquet``), named
    by ``table_names``, or a dict of DataFrames by table name. ``ntz`` reads
    instants as local (zone-less) timestamps; ``value_type`` ``decimal(p,s)``
    makes every sum exact. ``mode`` is ``errorifexists``, ``append`` or
    ``overwrite`` and concerns ``out`` as a whole, or ``replace`` and concerns
    the rows of ``run_id`` there. ``table`` publishes the rows as that run of a
    catalog table over ``out`` instead (Parquet; what the run had is replaced)."""
    check_unit(unit)
    if output_format not in ("parquet", "csv"):
        raise ValueError(f"unknown output format {output_format!r}")
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    frames = datafiles if isinstance(datafiles, dict) else None
    table_names = list(frames) if frames is not None else list(table_names or [])
    missing = [n for n in (GENERATION, INTERCHANGE, RESOURCES) if n not in table_names]
    if missing:
        raise ValueError(f"table_names must include {missing}")
    run_id = run_id or uuid.uuid4().hex
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", run_id):
        raise ValueError(f"run_id {run_id!r} must be of letters, digits, '_', '.' and '-'")
    if table and output_format != "parquet":
        raise ValueError("a table is published as parquet")
    if not table and mode == "append" and path_exists(spark, f"{out.rstrip('/')}/{RUN_ID}={run_id}"):
        raise ValueError(f"{out!r} holds a run {run_id!r} already")
    t_job = time.time()
    attempt = next_attempt(spark, metrics_path, run_id) if metrics_path else 1
    elapsed: dict[str, float] = {}
    metrics = metric_rows(run_id, STAGE_START, {
        "datafiles": table_names if frames is not None else datafiles, "tables": table_names,
        "aggregation_unit": unit, "csv_separator": sep})
    at = [STAGE_LOAD_DATA]  # the stage the job is in

    def ended(stage: str, since: float, values: dict) -> None:
        elapsed[stage] = time.time() - since
        metrics.extend(metric_rows(run_id, stage, {"elapsed_s": elapsed[stage], **values}))

    rows = None
    try:
        t = time.time()
        with job_description(spark, f"gridload {run_id}: {STAGE_LOAD_DATA}"):
            tables = frames if frames is not None else load_tables(
                spark, datafiles, table_names, sep, ntz=ntz, value_type=value_type,
                fmt=input_format, register=False)
        ended(STAGE_LOAD_DATA, t, {})

        at[0] = STAGE_INITIAL_STATS
        t = time.time()
        counts, size = {}, None
        if profile:
            with job_description(spark, f"gridload {run_id}: {STAGE_INITIAL_STATS}"):
                counts, size = _profile(tables)
        stats = {"num_tables": len(tables)}
        for name, df in tables.items():
            stats[f"count.{name}"] = counts.get(name)
            stats[f"schema.{name}"] = json.dumps(schema_json(df))
        ended(STAGE_INITIAL_STATS, t, stats)

        at[0] = STAGE_PROCESS
        t_process = time.time()
        generation = aggregate_generation(tables[GENERATION], tables[RESOURCES], unit,
                                          broadcast_max_rows, broadcast_max_bytes, size)
        load, seen = observed_load(generation, aggregate_interchange(tables[INTERCHANGE], unit), unit)
        t_load = time.time()
        with job_description(spark, f"gridload {run_id}: {STAGE_PROCESS}"):
            path, written = _write_run(spark, load, run_id, out, sep, output_format, mode, table,
                                       seen)
        t_written = time.time()
        stages = stage_values(seen)
        for name, values in stages.items():
            if name in STAGE_TABLES:
                metrics.extend(metric_rows(run_id, name, {
                    "tablename": STAGE_TABLES[name], "aggregation_unit": unit, **values}))
        t = time.time()
        with job_description(spark, f"gridload {run_id}: peak"):
            top = peak_load(written).collect()
        peak = None
        if top:
            peak = {SUBSYSTEM: top[0][SUBSYSTEM], VALUE: top[0][VALUE]}
            if DATA in written.columns:
                peak[DATA] = top[0][DATA].isoformat() if top[0][DATA] is not None else None
        elapsed["peak"] = time.time() - t
        elapsed[STAGE_LOAD] = t_written - t_load
        metrics.extend(metric_rows(run_id, STAGE_LOAD, {
            "aggregation_unit": unit, **stages[STAGE_LOAD], "elapsed_s": elapsed[STAGE_LOAD],
            "elapsed_s_stats": elapsed["peak"], "peak_subsistema": peak and peak[SUBSYSTEM],
            "peak_valor": peak and peak[VALUE], "peak_data": peak and peak.get(DATA)}))
        ended(STAGE_PROCESS, t_process, {"aggregation_unit": unit, "output": path})

        if collect_rows:
            at[0] = STAGE_TO_LIST
            t = time.time()
            rows = to_rows(written, max_collect_rows)
            ended(STAGE_TO_LIST, t, {RECORD_COUNT: len(rows)})
    except Exception as error:
        text = f"{type(error).__name__}: {error}"
        metrics.extend(metric_rows(run_id, STAGE_FAILED, {"failed_stage": at[0],
                                                          "error": text[:2000]}))
        raise
    finally:
        elapsed[STAGE_END] = time.time() - t_job
        metrics.extend(metric_rows(run_id, STAGE_END, {"elapsed_s_total": elapsed[STAGE_END]}))
        if metrics_path:
            put_attempt(spark, metrics, metrics_path, run_id, attempt)

    return LoadJobResult(run_id=run_id, unit=unit, output=path, table_counts=counts,
                         stages=stages, peak=peak, rows=rows, elapsed=elapsed)


def _split(values: list[str]) -> list[str]:
    return [item for value in values for item in value.split(";") if item]


def _resolve(name: str, data_dir: str) -> str:
    if "/" not in name and "." not in name:
        candidate = os.path.abspath(os.path.join(data_dir, f"{name}.csv"))
        if os.path.exists(candidate):
            return candidate
    return name


def main(argv: list[str] | None = None) -> LoadJobResult:
    from ..session import build_session, scratch_path

    p = argparse.ArgumentParser(description="Regional electric load (generation - interchange)")
    # Flag names of the command line.
    p.add_argument("--datafiles", nargs="+", required=True)
    p.add_argument("--table_names", nargs="+", required=True)
    p.add_argument("--aggreg_unit", required=True, choices=("diario", "mensal"))
    p.add_argument("--sep", default=";")
    p.add_argument("--out", help="output table (default: a new folder under the shared folder)")
    p.add_argument("--data-dir", default="data", help="folder of bare data file names")
    p.add_argument("--collect", action="store_true", help="also print the load rows")
    p.add_argument("--metrics")
    p.add_argument("--format", default="parquet", choices=("parquet", "csv"))
    p.add_argument("--input-format", default="csv", choices=("csv", "parquet"))
    p.add_argument("--mode", default="errorifexists", choices=MODES)
    p.add_argument("--run-id", help="name of the run (default: a new one); a retry takes the same")
    p.add_argument("--table", help="publish the load as this run of a catalog table over --out")
    p.add_argument("--value-type", default="double",
                   help="measure type: double, or decimal(p,s) for exact sums")
    p.add_argument("--local-time", action="store_true",
                   help="read instants as zone-less local timestamps")
    p.add_argument("--no-profile", action="store_true",
                   help="skip the input row counts (a second read of CSV input)")
    p.add_argument("--master", default="local[*]")
    a = p.parse_args(argv)
    spark = build_session(a.master)
    files = [_resolve(f, a.data_dir) for f in _split(a.datafiles)]
    out = a.out or scratch_path(spark, f"carga-{a.aggreg_unit}")
    res = run_load_job(spark, files, _split(a.table_names), a.aggreg_unit, out, a.sep,
                       a.metrics, a.format, a.mode, collect_rows=a.collect, ntz=a.local_time,
                       value_type=a.value_type, profile=not a.no_profile,
                       input_format=a.input_format, run_id=a.run_id, table=a.table)
    report = {"run_id": res.run_id, "output": res.output, "peak": res.peak,
              "stages": res.stages, "table_counts": res.table_counts, "elapsed": res.elapsed}
    if a.collect:
        report["rows"] = res.rows
    print(json.dumps(report, default=str))
    return res


if __name__ == "__main__":
    main()
