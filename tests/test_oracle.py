"""Every registered query against its SQL in DuckDB, on the sf0.01 tables."""

import pytest

import __spark_entry__ as E
from conftest import SF_ORACLE
from gridload.plans.oracle import ORACLE_SQL as ORACLE
from gridload.plans.queries import QUERIES
from oracle_compare import compare


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, name):
    r = compare(spark, QUERIES[name], ORACLE[name], SF_ORACLE)
    assert r["columns_match"], r
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["values_match"], r


def test_every_query_has_oracle_or_is_declared_rows_only():
    rows_only = set(QUERIES) - set(ORACLE)
    assert rows_only == set()


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["subsistema", "data", "valor"]
    assert df.count() > 0


def test_table_schemas_rows(spark):
    df = QUERIES["table_schemas"](spark, SF_ORACLE)
    rows = {(r.tabela, r.coluna): r for r in df.collect()}
    assert rows[("lineitem", "l_shipdate")].tipo == "timestamp_ntz"
    assert rows[("supplier", "s_suppkey")].posicao == 1
    assert rows[("orders", "o_orderkey")].registros == 15000
    assert len(rows) == 11 + 6 + 4


@pytest.mark.parametrize("unit,name", [("diario", "load_daily"), ("mensal", "load_monthly"),
                                       ("diario", "generation_daily")])
def test_shuffle_path_matches_oracle(spark, unit, name):
    """The path taken when the plant dimension is too large to broadcast
    (pre-aggregate per plant, then shuffle join) gives the same rows."""
    from gridload import aggregate_generation, regional_load
    from gridload.sources import tpch

    def query(s, sf):
        t = tpch.domain_tables(s, sf)
        if name == "generation_daily":
            return aggregate_generation(t["geracao"], t["recursos"], unit, broadcast_max_rows=0)
        return regional_load(t["geracao"], t["intercambio"], t["recursos"], unit,
                             broadcast_max_rows=0)

    r = compare(spark, query, ORACLE[name], SF_ORACLE)
    assert r["spark_rows"] == r["oracle_rows"] and r["values_match"] and r["exact_match"], r


def test_load_ranked_is_the_whole_load_in_order(spark):
    rows = QUERIES["load_ranked"](spark, SF_ORACLE).collect()
    assert len(rows) == QUERIES["load_daily"](spark, SF_ORACLE).count()
    keys = [(-r.valor, r.subsistema, r.data) for r in rows]
    assert keys == sorted(keys)
