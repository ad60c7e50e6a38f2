"""Run a registered query in Spark and its SQL in DuckDB, then compare.

Comparison: row count, column names, and the multiset of rows. Doubles must be
equal after rounding to ``digits`` significant decimals (exact sums make them
equal bit for bit in practice; the rounding only absorbs printing noise).
"""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits: int):
    if v is None:
        return ("~null",)
    if isinstance(v, float):
        if math.isnan(v):
            return ("~nan",)
        return ("f", float(f"{v:.{digits}e}"))
    if isinstance(v, decimal.Decimal):
        return ("f", float(f"{float(v):.{digits}e}"))
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("f", float(v))
    if isinstance(v, dt.datetime):
        return ("t", v.replace(tzinfo=None).isoformat())
    return ("s", str(v))


def normalise(rows, columns, digits=12):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(_norm(r[k], digits) for k in order) for r in rows)


def compare(spark, query, sql: str, sf_dir: str, digits: int = 12) -> dict:
    df = query(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    con = duck(sf_dir)
    cur = con.execute(sql)
    d_cols = [c[0] for c in cur.description]
    d_rows = cur.fetchall()
    out = {"spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "columns_match": sorted(s_cols) == sorted(d_cols),
           "spark_columns": s_cols, "oracle_columns": d_cols}
    out["values_match"] = (out["columns_match"]
                           and normalise(s_rows, s_cols, digits) == normalise(d_rows, d_cols, digits))
    exact_s = sorted(tuple(repr(r[k]) for k in sorted(range(len(s_cols)), key=lambda k: s_cols[k]))
                     for r in s_rows)
    exact_d = sorted(tuple(repr(r[k]) for k in sorted(range(len(d_cols)), key=lambda k: d_cols[k]))
                     for r in d_rows)
    out["exact_match"] = exact_s == exact_d
    return out
