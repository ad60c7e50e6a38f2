"""Reference SQL for each registered query, runnable by DuckDB (and Spark SQL)
on the driver's tables. Used only to check results; the queries themselves
run the library's DataFrame operators.
"""

from __future__ import annotations

DOMAIN_MAP = """
geracao AS (
  SELECT l_shipdate AS data, CAST(l_partkey AS VARCHAR(20)) AS id_usina,
         CAST(l_suppkey AS VARCHAR(20)) AS guid_usina,
         CAST(l_quantity AS DECIMAL(18,4)) AS valor
  FROM lineitem),
recursos AS (
  SELECT CAST(s.s_suppkey AS VARCHAR(20)) AS guid_recurso, r.r_name AS subsistema
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
                  JOIN region r ON n.n_regionkey = r.r_regionkey),
intercambio AS (
  SELECT o.o_orderdate AS data, r.r_name AS subsistema,
         CAST(CASE WHEN o.o_orderstatus = 'F' THEN -o.o_totalprice ELSE o.o_totalprice END
              AS DECIMAL(18,4)) AS valor
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
                JOIN nation n ON c.c_nationkey = n.n_nationkey
                JOIN region r ON n.n_regionkey = r.r_regionkey),
gd AS (SELECT r.subsistema, t.data, CAST(SUM(t.valor) AS DOUBLE) AS valor
       FROM geracao t JOIN recursos r ON t.guid_usina = r.guid_recurso
       GROUP BY r.subsistema, t.data),
gm AS (SELECT r.subsistema, CAST(SUM(t.valor) AS DOUBLE) / COUNT(t.valor) AS valor
       FROM geracao t JOIN recursos r ON t.guid_usina = r.guid_recurso
       GROUP BY r.subsistema),
id AS (SELECT t.subsistema, t.data, CAST(SUM(t.valor) AS DOUBLE) AS valor
       FROM intercambio t GROUP BY t.subsistema, t.data),
im AS (SELECT t.subsistema, CAST(SUM(t.valor) AS DOUBLE) / COUNT(t.valor) AS valor
       FROM intercambio t GROUP BY t.subsistema),
cd AS (SELECT gd.subsistema, gd.data, gd.valor - id.valor AS valor
       FROM gd JOIN id ON gd.subsistema = id.subsistema AND gd.data = id.data),
cm AS (SELECT gm.subsistema, gm.valor - im.valor AS valor
       FROM gm JOIN im ON gm.subsistema = im.subsistema)
"""


def _with(body: str) -> str:
    return f"WITH {DOMAIN_MAP} {body}"


STAGES = """
SELECT 'aggreg_geracao' AS stage, COUNT(0) AS record_count, MAX(valor) AS max_valor FROM gd
UNION ALL SELECT 'aggreg_intercambio' AS stage, COUNT(0) AS record_count, MAX(valor) AS max_valor
FROM id
UNION ALL SELECT 'calculate_carga' AS stage, COUNT(0) AS record_count, MAX(valor) AS max_valor
FROM cd"""

ORACLE_SQL: dict[str, str] = {
    "generation_with_subsystem": _with(
        "SELECT r.subsistema, t.data, t.guid_usina, CAST(t.valor AS DOUBLE) AS valor "
        "FROM geracao t JOIN recursos r ON t.guid_usina = r.guid_recurso"),
    "generation_daily": _with("SELECT subsistema, data, valor FROM gd"),
    "generation_monthly": _with("SELECT subsistema, valor FROM gm"),
    "interchange_daily": _with("SELECT subsistema, data, valor FROM id"),
    "interchange_monthly": _with("SELECT subsistema, valor FROM im"),
    "load_daily": _with("SELECT subsistema, data, valor FROM cd"),
    "load_monthly": _with("SELECT subsistema, valor FROM cm"),
    "load_job_daily": _with("SELECT subsistema, data, valor FROM cd"),
    "load_job_csv": _with("SELECT subsistema, data, valor FROM cd"),
    "load_job_metrics": _with(STAGES),
    "load_daily_large_dimension": _with("SELECT subsistema, data, valor FROM cd"),
    "load_ranked": _with(
        "SELECT subsistema, data, valor FROM cd ORDER BY valor DESC, subsistema, data"),
    "load_top_n": _with(
        "SELECT subsistema, data, valor, "
        "CAST(ROW_NUMBER() OVER (ORDER BY valor DESC, subsistema, data) AS BIGINT) AS pos "
        "FROM cd ORDER BY valor DESC, subsistema, data LIMIT 100"),
    "peak_load_daily": _with(
        "SELECT subsistema, data, valor FROM cd ORDER BY valor DESC, subsistema, data LIMIT 1"),
    "peak_load_monthly": _with(
        "SELECT subsistema, valor FROM cm ORDER BY valor DESC, subsistema LIMIT 1"),
    "peak_load_per_day": _with(
        "SELECT subsistema, data, valor FROM ("
        " SELECT subsistema, data, valor,"
        " RANK() OVER (PARTITION BY data ORDER BY valor DESC) AS rnk FROM cd) x "
        "WHERE rnk = 1"),
    "extract_interchange": """
SELECT o_orderdate AS data, CAST(o_custkey AS VARCHAR(20)) AS subsistema, o_totalprice AS valor
FROM orders
WHERE YEAR(o_orderdate) = 1998 AND MONTH(o_orderdate) = 1
  AND o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'""",
    "extract_generation": """
SELECT l_shipdate AS data, l_quantity AS valor, CAST(l_partkey AS VARCHAR(20)) AS id_usina,
       CAST(l_suppkey AS VARCHAR(20)) AS guid_usina
FROM lineitem
WHERE YEAR(l_shipdate) = 1998 AND MONTH(l_shipdate) = 1
  AND l_returnflag = 'A' AND l_linestatus = 'F'""",
    "extract_resources": """
SELECT CAST(c_custkey AS VARCHAR(20)) AS id_recurso, c_name AS guid_recurso,
       NULLIF(c_mktsegment, 'MACHINERY') AS subsistema
FROM customer WHERE NULLIF(c_mktsegment, 'MACHINERY') IS NOT NULL""",
    "sink_csv_roundtrip": (
        "SELECT o_orderdate AS data, o_orderpriority AS subsistema, o_totalprice AS valor "
        "FROM orders"),
    "scan_select_all": "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey",
    "cast_timestamp": (
        "SELECT event_id, CAST(CAST(ts AS VARCHAR(30)) AS TIMESTAMP) AS ts FROM events"),
    "cast_string": (
        "SELECT CAST(s_suppkey AS VARCHAR(20)) AS guid_recurso, "
        "CAST(s_nationkey AS VARCHAR(20)) AS id_recurso FROM supplier"),
    "table_counts": """
SELECT 'lineitem' AS tabela, COUNT(0) AS c FROM lineitem
UNION ALL SELECT 'orders' AS tabela, COUNT(0) AS c FROM orders
UNION ALL SELECT 'supplier' AS tabela, COUNT(0) AS c FROM supplier""",
    "table_schemas": """
WITH cols AS (
  SELECT table_name AS tabela, CAST(ordinal_position AS INTEGER) AS posicao,
         column_name AS coluna,
         CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
                        WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string'
                        WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END AS tipo,
         is_nullable = 'YES' AS anulavel
  FROM information_schema.columns
  WHERE table_name IN ('lineitem', 'orders', 'supplier')),
counts AS (
  SELECT 'lineitem' AS tabela, COUNT(0) AS registros FROM lineitem
  UNION ALL SELECT 'orders' AS tabela, COUNT(0) AS registros FROM orders
  UNION ALL SELECT 'supplier' AS tabela, COUNT(0) AS registros FROM supplier)
SELECT c.tabela, c.posicao, c.coluna, c.tipo, c.anulavel, n.registros
FROM cols c JOIN counts n ON c.tabela = n.tabela""",
    "stage_metrics": _with(STAGES),
}
for _name, _same in (("extract_job_generation", "extract_generation"),
                     ("extract_job_interchange", "extract_interchange"),
                     ("extract_job_resources", "extract_resources"),
                     ("load_daily_bucketed", "load_daily"), ("load_published", "load_daily"),
                     ("load_daily_incremental", "load_daily"),
                     ("load_monthly_incremental", "load_monthly")):
    ORACLE_SQL[_name] = ORACLE_SQL[_same]
ORACLE_SQL["extract_job_periods"] = """
SELECT l_shipdate AS data, l_quantity AS valor, CAST(l_partkey AS VARCHAR(20)) AS id_usina,
       CAST(l_suppkey AS VARCHAR(20)) AS guid_usina
FROM lineitem
WHERE (YEAR(l_shipdate), MONTH(l_shipdate)) IN (
        SELECT (YEAR(o_orderdate), MONTH(o_orderdate)) FROM orders
        WHERE YEAR(o_orderdate) = 1995 AND o_orderstatus = 'P')
  AND l_returnflag = 'A' AND l_linestatus = 'F'"""
ORACLE_SQL["load_job_retried"] = _with(STAGES)
ORACLE_SQL["load_rows"] = _with(
    "SELECT CAST(ROW_NUMBER() OVER (ORDER BY valor DESC, subsistema) AS BIGINT) AS linha, "
    "subsistema, valor FROM cm")
ORACLE_SQL["load_positions"] = _with(
    "SELECT subsistema, data, valor, "
    "CAST(ROW_NUMBER() OVER (ORDER BY valor DESC, subsistema, data) AS BIGINT) AS pos FROM cd")

# The lines of the damaged file, and what is wrong with each.
DAMAGED = """
t AS (SELECT o_orderkey AS k, o_orderpriority AS subsistema, o_totalprice AS valor,
             CASE WHEN o_orderkey % 89 = 0 THEN 'soon'
                  ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS d,
             CASE WHEN o_orderkey % 97 = 0 THEN 'n/a'
                  ELSE printf('%.2f', CAST(o_totalprice AS DOUBLE)) END AS v FROM orders),
l AS (SELECT *, CASE WHEN k % 83 = 0 THEN concat_ws(';', d, subsistema, v, 'more')
                     WHEN k % 79 = 0 THEN concat_ws(';', d, subsistema)
                     ELSE concat_ws(';', d, subsistema, v) END AS linha,
             CASE WHEN k % 83 = 0 OR k % 79 = 0 THEN 'wrong number of fields'
                  WHEN d = 'soon' OR v = 'n/a' THEN 'bad value' END AS motivo FROM t)
"""
ORACLE_SQL["quarantine_lines"] = f"""
WITH {DAMAGED} SELECT motivo, CASE WHEN motivo = 'bad value' THEN
  CASE WHEN d = 'soon' THEN 'data' ELSE 'valor' END END AS coluna, linha
FROM l WHERE motivo IS NOT NULL"""
ORACLE_SQL["quarantine_counts"] = f"""
WITH {DAMAGED} SELECT subsistema, COUNT(0) AS c,
  CAST(SUM(CAST(v AS DECIMAL(18,4))) AS DOUBLE) AS valor
FROM l WHERE motivo IS NULL GROUP BY subsistema
UNION ALL SELECT NULL, COUNT(0), NULL FROM l WHERE motivo IS NOT NULL"""


def _footer(table: str, columns: tuple) -> str:
    rows = [f"SELECT '{table}' AS tabela, NULL AS coluna, COUNT(0) AS c, NULL AS menor, "
            f"NULL AS maior FROM {table}"]
    rows += [f"SELECT '{table}', '{c}', COUNT({c}), CAST(MIN({c}) AS VARCHAR), "
             f"CAST(MAX({c}) AS VARCHAR) FROM {table}" for c in columns]
    return " UNION ALL ".join(rows)


ORACLE_SQL["table_footers"] = " UNION ALL ".join(
    _footer(t, c) for t, c in (("lineitem", ("l_orderkey", "l_suppkey")),
                               ("orders", ("o_custkey",)), ("supplier", ("s_suppkey",))))
