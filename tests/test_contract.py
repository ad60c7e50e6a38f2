"""The driver contract of __spark_entry__.py."""

import inspect

import __spark_entry__ as E
from conftest import SF_SMALL
from gridload.plans.oracle import ORACLE_SQL
from gridload.plans.queries import QUERIES


def test_entry_schema_is_stable(spark):
    first, second = E.entry(spark), E.entry(spark)
    assert first.schema == second.schema
    assert [f.name for f in first.schema] == ["subsistema", "data", "valor"]


def test_every_query_has_oracle_sql_and_takes_spark_and_dir():
    queries, oracle = QUERIES, ORACLE_SQL
    assert set(queries) == set(oracle)
    assert set(queries) <= set(E.queries()) and set(oracle) <= set(E.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())
    for name, fn in queries.items():
        assert list(inspect.signature(fn).parameters)[:2] == ["spark", "sf_dir"], name
        assert oracle[name].strip(), name


def test_output_columns_are_unique(spark):
    for name, fn in QUERIES.items():
        cols = fn(spark, SF_SMALL).columns
        assert len(cols) == len(set(cols)), name


def test_bench_prints_one_json_line():
    import json
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = dict(os.environ, BENCH_SF_DIR=SF_SMALL, BENCH_CPUS="2", BENCH_RUNS="1",
               BENCH_WARMUP="0", BENCH_QUERIES="scan_select_all,load_monthly", BENCH_MEM="2g")
    out = subprocess.run([sys.executable, os.path.join(root, "bench.py")], env=env,
                         capture_output=True, text=True, timeout=600, cwd=root)
    lines = [ln for ln in out.stdout.splitlines() if ln.startswith("{")]
    assert len(lines) == 1, out.stdout + out.stderr[-2000:]
    report = json.loads(lines[0])
    assert {"metric", "value", "unit", "queries", "sf"} <= set(report)
    assert report["unit"] == "sec" and report["sf"] == "0.001" and not report["errors"]
    assert set(report["queries"]) == {"scan_select_all", "load_monthly"}
