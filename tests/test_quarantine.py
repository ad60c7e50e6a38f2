"""Bad CSV lines: which, why, and that none is lost."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_ORACLE
from fixtures import write
from gridload import DAILY, regional_load
from gridload.plans import queries as Q
from gridload.schemas import interchange_schema, schema_for
from gridload.sources.quarantine import (BAD_FIELDS, BAD_VALUE, read_quarantined,
                                         read_tables_quarantined)

HEADER = "data;subsistema;valor\n"
LINES = {
    "2018-01-01T00:00:00.000Z;SE;1.5": None,
    "2018-01-02T00:00:00.000Z;SE;": None,
    "2018-01-02T00:00:00.000Z;;NaN": None,
    ";S;2.0": None,
    '2018-01-03T00:00:00.000Z;"a;b";3': None,
    "2018-01-03T00:00:00.000Z;SE;x1": (BAD_VALUE, "valor"),
    "tomorrow;SE;1.0": (BAD_VALUE, "data"),
    "tomorrow;SE;many": (BAD_VALUE, "data"),
    "2018-01-03T00:00:00.000Z;SE": (BAD_FIELDS, None),
    "2018-01-03T00:00:00.000Z;SE;1;2": (BAD_FIELDS, None),
    "never;SE;1;2": (BAD_FIELDS, None),
    "alone": (BAD_FIELDS, None),
}


def files(workdir):
    lines = list(LINES)
    return [write(workdir, "a.csv", HEADER + "\n".join(lines[::2]) + "\n"),
            write(workdir, "b.csv", HEADER + "\n".join(lines[1::2]) + "\n")]


def test_each_line_is_good_or_set_aside_with_its_reason(spark, workdir):
    paths = files(workdir)
    got = read_quarantined(spark, paths, interchange_schema())
    bad = {r.linha: (r.motivo, r.coluna) for r in got.bad.collect()}
    assert bad == {k: v for k, v in LINES.items() if v}
    names = {r.linha: os.path.basename(r.arquivo) for r in got.bad.collect()}
    assert all(names[line] == ("a.csv" if k % 2 == 0 else "b.csv")
               for k, line in enumerate(LINES) if line in names)
    assert got.good.columns == ["data", "subsistema", "valor"]
    assert sorted(r.subsistema or "" for r in got.good.collect()) == ["", "S", "SE", "SE", "a;b"]


def test_counts_do_not_depend_on_what_is_selected(spark, workdir):
    got = read_quarantined(spark, files(workdir), interchange_schema())
    good = sum(v is None for v in LINES.values())
    assert got.good.count() == good and got.bad.count() == len(LINES) - good
    assert got.good.select("subsistema").count() == good
    assert len(got.good.select("subsistema").collect()) == good
    assert got.good.agg(F.count("valor")).collect()[0][0] == 4  # one of the five is empty
    assert len(got.bad.select("motivo").collect()) == len(LINES) - good


def test_columns_in_another_order_and_a_wrong_header(spark, workdir):
    path = write(workdir, "c.csv", "valor;data;subsistema\n1;2018-01-01T00:00:00Z;SE\nx;never;S\n")
    got = read_quarantined(spark, path, interchange_schema())
    assert [(r.subsistema, r.valor) for r in got.good.collect()] == [("SE", 1.0)]
    assert [(r.motivo, r.coluna) for r in got.bad.collect()] == [(BAD_VALUE, "valor")]
    with pytest.raises(ValueError, match="expected the columns"):
        read_quarantined(spark, write(workdir, "d.csv", "data;valor\n"), interchange_schema())


def test_file_without_lines_and_all_bad(spark, workdir):
    none = read_quarantined(spark, write(workdir, "e.csv", HEADER), interchange_schema())
    assert none.good.count() == 0 and none.bad.count() == 0
    bad = read_quarantined(spark, write(workdir, "f.csv", HEADER + "a\nb;c;d\n"),
                           interchange_schema())
    assert bad.good.count() == 0 and bad.bad.count() == 2


def test_load_over_good_lines_of_all_tables(spark, workdir):
    paths = [write(workdir, "g.csv", "data;valor;id_usina;guid_usina\n"
                   "2018-01-01T00:00:00Z;10;1;g1\n2018-01-01T00:00:00Z;ten;1;g1\n"),
             write(workdir, "i.csv", HEADER + "2018-01-01T00:00:00Z;SE;4\nx;SE;1\n"),
             write(workdir, "r.csv", "id_recurso;guid_recurso;subsistema\n1;g1;SE\n2\n")]
    names = ["geracao", "intercambio", "recursos"]
    good, bad = read_tables_quarantined(spark, paths, names)
    load = regional_load(good["geracao"], good["intercambio"], good["recursos"], DAILY).collect()
    assert [(r.subsistema, r.valor) for r in load] == [("SE", 6.0)]
    assert sorted((r.tabela, r.motivo, r.coluna) for r in bad.collect()) == [
        ("geracao", BAD_VALUE, "valor"), ("intercambio", BAD_VALUE, "data"),
        ("recursos", BAD_FIELDS, None)]
    with pytest.raises(ValueError, match="table names"):
        read_tables_quarantined(spark, paths, names[:2])


def test_decimal_measures_and_local_instants(spark, workdir):
    schema = schema_for("intercambio", ntz=True, value_type="decimal(6,2)")
    path = write(workdir, "h.csv", HEADER + "2018-01-01T00:00:00;SE;1234.25\n"
                 "2018-01-01T00:00:00;SE;123456.25\n")
    got = read_quarantined(spark, path, schema)
    assert got.good.count() + got.bad.count() == 2
    assert [float(r.valor) for r in got.good.collect()] == [1234.25]


def test_registered_counts_add_up(spark):
    rows = Q.quarantine_counts(spark, SF_ORACLE).collect()
    orders = spark.read.parquet(f"{SF_ORACLE}/orders.parquet").count()
    assert sum(r.c for r in rows) == orders
    assert Q.quarantine_lines(spark, SF_ORACLE).count() == sum(
        r.c for r in rows if r.subsistema is None) > 0
