"""Properties: agreement with a pandas brute force on random inputs, the
interchange balance of the real file, and invariance under partitioning."""

import datetime as dt

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import SF_SMALL
from fixtures import INTERCHANGE_CSV, write
from gridload import DAILY, MONTHLY, aggregate_interchange, regional_load
from gridload.schemas import generation_schema, interchange_schema, resources_schema
from gridload.sources import tpch
from gridload.sources.csv import read_interchange

DAYS = [dt.datetime(2018, 1, d) for d in (1, 2, 3)]
GUIDS = ["g1", "g2", "g3", "g4", None]
SUBS = ["SE", "S", "N"]
# quarters keep every sum exact in double, whatever the order
values = st.one_of(st.none(), st.integers(-400, 400).map(lambda k: k / 4))

gen_rows = st.lists(st.tuples(st.sampled_from(DAYS), values, st.just("p"),
                              st.sampled_from(GUIDS)), max_size=25)
res_rows = st.lists(st.tuples(st.just("r"), st.sampled_from(GUIDS), st.sampled_from(SUBS)),
                    max_size=6)
int_rows = st.lists(st.tuples(st.sampled_from(DAYS), st.sampled_from(SUBS), values),
                    max_size=20)


def brute_force(g, i, r, unit):
    gp = pd.DataFrame(g, columns=["data", "valor", "id_usina", "guid_usina"])
    rp = pd.DataFrame(r, columns=["id_recurso", "guid_recurso", "subsistema"])
    ip = pd.DataFrame(i, columns=["data", "subsistema", "valor"])
    gp = gp[gp.guid_usina.notna()]
    rp = rp[rp.guid_recurso.notna()]
    j = gp.merge(rp, left_on="guid_usina", right_on="guid_recurso")
    keys = ["subsistema", "data"] if unit == DAILY else ["subsistema"]
    how = (lambda s: s.sum(min_count=1)) if unit == DAILY else (lambda s: s.mean())
    ga = j.groupby(keys)["valor"].agg(how) if len(j) else pd.Series(dtype=float)
    ia = ip.groupby(keys)["valor"].agg(how) if len(ip) else pd.Series(dtype=float)
    out = {}
    for k, v in ga.items():
        if k in ia.index:
            out[k if isinstance(k, tuple) else (k,)] = v - ia[k]
    return {k: (None if pd.isna(v) else float(v)) for k, v in out.items()}


@settings(max_examples=15, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(g=gen_rows, i=int_rows, r=res_rows, unit=st.sampled_from([DAILY, MONTHLY]),
       bmax=st.sampled_from([500_000, 0, None]))
def test_matches_brute_force(spark, g, i, r, unit, bmax):
    gd = spark.createDataFrame(g, generation_schema(ntz=True))
    idf = spark.createDataFrame(i, interchange_schema(ntz=True))
    rd = spark.createDataFrame(r, resources_schema())
    got = {}
    for row in regional_load(gd, idf, rd, unit, bmax).collect():
        key = (row.subsistema, row.data) if unit == DAILY else (row.subsistema,)
        got[key] = row.valor
    want = brute_force(g, i, r, unit)
    assert set(got) == set(want)
    for k in want:
        if want[k] is None:
            assert got[k] is None
        else:
            assert got[k] == pytest.approx(want[k], abs=1e-9)


def test_hand_fixture_interchange_nets_to_zero_each_day(spark, workdir):
    df = read_interchange(spark, write(workdir, "i.csv", INTERCHANGE_CSV))
    per_day = {}
    for r in aggregate_interchange(df, DAILY).collect():
        per_day[r.data] = per_day.get(r.data, 0.0) + r.valor
    assert len(per_day) == 3 and all(v == 0.0 for v in per_day.values())


@pytest.mark.parametrize("unit", [DAILY, MONTHLY])
def test_invariant_under_partitioning(spark, unit):
    t = tpch.domain_tables(spark, SF_SMALL)

    def run(n):
        return sorted(tuple(r) for r in regional_load(
            t["geracao"].repartition(n), t["intercambio"].repartition(n),
            t["recursos"].repartition(n), unit).collect())

    one, many = run(1), run(7)
    assert one == many and len(one) > 0


pairs = st.lists(st.tuples(st.sampled_from(DAYS), st.sampled_from(SUBS), st.sampled_from(SUBS),
                           st.integers(1, 400).map(lambda k: k / 4)), min_size=1, max_size=12)
plant_gen = st.lists(st.tuples(st.sampled_from(SUBS), st.integers(0, 400).map(lambda k: k / 4)),
                     min_size=1, max_size=6)


@settings(max_examples=8, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(flows=pairs, gens=plant_gen)
def test_balanced_interchange_makes_load_sum_equal_generation_sum(spark, flows, gens):
    """Each flow is exported by one subsystem and imported by another, so
    every day nets to zero; when every subsystem has generation and
    interchange on that day, the load summed over subsystems equals the
    generation summed over subsystems."""
    inter_rows = []
    for d, a, b, v in flows:
        inter_rows += [(d, a, v), (d, b, -v)]
    # every subsystem: a zero interchange row and some generation on each day
    inter_rows += [(d, s, 0.0) for d in DAYS for s in SUBS]
    res_rows = [(s, f"plant-{s}", s) for s in SUBS]
    gen_rows = [(d, v, "p", f"plant-{s}") for d in DAYS for s, v in gens]
    gen_rows += [(d, 0.0, "p", f"plant-{s}") for d in DAYS for s in SUBS]
    load = regional_load(spark.createDataFrame(gen_rows, generation_schema(ntz=True)),
                         spark.createDataFrame(inter_rows, interchange_schema(ntz=True)),
                         spark.createDataFrame(res_rows, resources_schema()), DAILY)
    per_day = {}
    for r in load.collect():
        per_day[r.data] = per_day.get(r.data, 0.0) + r.valor
    gen_per_day = sum(v for _, v in gens)
    assert set(per_day) == set(DAYS)
    assert all(v == pytest.approx(gen_per_day, abs=1e-9) for v in per_day.values())


@pytest.mark.parametrize("unit", [DAILY, MONTHLY])
def test_hot_plant_same_result_on_both_paths(spark, unit):
    """A third of the generation rows re-keyed to one plant: the broadcast
    path and the pre-aggregate + shuffle path agree exactly (DECIMAL sums)."""
    from pyspark.sql import functions as F

    from conftest import SF_ORACLE
    from gridload import aggregate_generation

    t = tpch.domain_tables(spark, SF_ORACLE)
    hot = t["recursos"].agg(F.min("guid_recurso")).first()[0]
    gen = t["geracao"].withColumn(
        "guid_usina", F.when(F.pmod(F.hash("id_usina", "data"), F.lit(3)) == 0, F.lit(hot))
                       .otherwise(F.col("guid_usina")))
    share = gen.where(F.col("guid_usina") == hot).count() / gen.count()
    assert share > 0.3
    broadcast = sorted(map(tuple, aggregate_generation(gen, t["recursos"], unit).collect()))
    shuffled = sorted(map(tuple, aggregate_generation(gen, t["recursos"], unit,
                                                      broadcast_max_rows=0).collect()))
    assert broadcast == shuffled and len(broadcast) > 0


catalog_rows = st.lists(st.tuples(
    st.sampled_from(DAYS + [dt.datetime(2018, 2, 1), dt.datetime(2019, 1, 5)]),
    st.sampled_from(["SE", "S", None]), st.integers(-50, 50).map(float),
    st.sampled_from(["DI", "HR"]), st.sampled_from(["Consistido", "Preliminar"])),
    max_size=20)


@settings(max_examples=10, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(rows=catalog_rows, year=st.sampled_from([2018, 2019]), month=st.sampled_from([1, 2]))
def test_extraction_matches_python_filter(spark, rows, year, month):
    from pyspark.sql import functions as F

    from gridload.sources import extract as X

    full = [(d, s, v, str(d.year), str(d.month), p, c) for d, s, v, p, c in rows]
    src = spark.createDataFrame(full, f"{X.START_COL} timestamp_ntz, {X.SUBSYSTEM_COL} string, "
                                      f"{X.INTERCHANGE_VALUE_COL} double, {X.YEAR_COL} string, "
                                      f"{X.MONTH_COL} string, {X.PERIOD_COL} string, "
                                      f"{X.CLASS_COL} string")
    got = sorted(map(tuple, X.extract_interchange(src, year, month).collect()),
                 key=repr)
    want = sorted(((d, s, v) for d, s, v, y, m, p, c in full
                   if y == str(year) and m == str(month) and p == "DI" and c == "Consistido"),
                  key=repr)
    assert got == want
    res = sorted(map(tuple, X.extract_resources(src.select(
        F.col(X.SUBSYSTEM_COL).alias(X.RESOURCE_ID_COL),
        F.col(X.CLASS_COL).alias(X.RESOURCE_GUID_COL),
        F.col(X.SUBSYSTEM_COL))).collect()), key=repr)
    assert res == sorted(((s, c, s) for d, s, v, y, m, p, c in full if s is not None), key=repr)
