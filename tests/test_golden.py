"""Golden values on the hand fixture, through the CSV readers, on both join
shapes (broadcast dimension, and pre-aggregate + shuffle join)."""

import datetime as dt

import pytest

from fixtures import (GENERATION_CSV, GENERATION_MONTHLY, INTERCHANGE_CSV, INTERCHANGE_DAILY,
                      INTERCHANGE_MONTHLY, LOAD_DAILY, LOAD_MONTHLY, RESOURCES_CSV, write)
from gridload import (DAILY, MONTHLY, aggregate_generation, aggregate_interchange,
                      compute_load, peak_load, regional_load)
from gridload.sources.csv import read_generation, read_interchange, read_resources

BMAX = pytest.mark.parametrize("bmax", [500_000, 0], ids=["broadcast", "shuffle"])


def day(d, month=1):
    return dt.datetime(2018, month, d)


@pytest.fixture()
def tables(spark, workdir):
    return (read_generation(spark, write(workdir, "g.csv", GENERATION_CSV)),
            read_interchange(spark, write(workdir, "i.csv", INTERCHANGE_CSV)),
            read_resources(spark, write(workdir, "r.csv", RESOURCES_CSV)))


def by_day(df):
    """{(subsystem, day-of-month): value} of a daily result."""
    return {(r.subsistema, r.data.day): r.valor for r in df.collect()}


def by_sub(df):
    return {r.subsistema: r.valor for r in df.collect()}


def test_reader_types(tables):
    gen, inter, res = tables
    assert [(f.name, f.dataType.simpleString()) for f in inter.schema] == [
        ("data", "timestamp"), ("subsistema", "string"), ("valor", "double")]
    assert [f.dataType.simpleString() for f in gen.schema] == [
        "timestamp", "double", "string", "string"]
    assert [f.dataType.simpleString() for f in res.schema] == ["string"] * 3


def test_interchange_golden(tables):
    _, inter, _ = tables
    assert inter.count() == 13
    assert by_day(aggregate_interchange(inter, DAILY)) == pytest.approx(INTERCHANGE_DAILY)
    assert by_sub(aggregate_interchange(inter, MONTHLY)) == pytest.approx(INTERCHANGE_MONTHLY)


@BMAX
def test_generation_golden(tables, bmax):
    gen, _, res = tables
    daily = {(r.subsistema, r.data): r.valor
             for r in aggregate_generation(gen, res, DAILY, bmax).collect()}
    assert daily == {("S", day(1)): 300.25, ("S", day(2)): 0.0, ("SE", day(1)): 6000.5,
                     ("SE", day(2)): 5200.0, ("N", day(1, 2)): 7.0}
    assert by_sub(aggregate_generation(gen, res, MONTHLY, bmax)) == GENERATION_MONTHLY


@BMAX
def test_load_golden(tables, bmax):
    gen, inter, res = tables
    assert by_day(regional_load(gen, inter, res, DAILY, bmax)) == pytest.approx(LOAD_DAILY)
    assert by_sub(regional_load(gen, inter, res, MONTHLY, bmax)) == pytest.approx(LOAD_MONTHLY)


def test_peak_golden(tables):
    gen, inter, res = tables
    (p,) = peak_load(regional_load(gen, inter, res, DAILY)).collect()
    assert (p.subsistema, p.data, p.valor) == ("SE", day(2), 6100.0)
    (m,) = peak_load(regional_load(gen, inter, res, MONTHLY)).collect()
    assert (m.subsistema, m.valor) == ("SE", 2687.5625)


def test_compute_load_is_inner(tables):
    gen, inter, res = tables
    g = aggregate_generation(gen, res, DAILY)
    i = aggregate_interchange(inter, DAILY)
    keys = {(r.subsistema, r.data) for r in compute_load(g, i, DAILY).collect()}
    # N: generation only in February, interchange only in January; NE/AR: no plants
    assert keys == {("S", day(1)), ("S", day(2)), ("SE", day(1)), ("SE", day(2))}


def test_generated_month_profile(spark, workdir):
    """A month of daily interchange made by rule: 7 subsystems x 31 days, two
    rows each; every day nets to zero and three subsystems stand on this side
    only."""
    subs = ["SE", "S", "N", "NE", "AR", "PY", "UY"]
    lines = ["data;subsistema;valor"]
    for d in range(1, 32):
        for k, sub in enumerate(subs):
            out = d * (k + 1) * 1.5
            # what one subsystem sends, the next one of the ring receives
            lines.append(f"2018-01-{d:02d}T00:00:00.000Z;{sub};{out}")
            lines.append(f"2018-01-{d:02d}T00:00:00.000Z;{subs[(k + 1) % 7]};{-out}")
    df = read_interchange(spark, write(workdir, "month.csv", "\n".join(lines) + "\n"))
    assert df.count() == 434
    daily = by_day(aggregate_interchange(df, DAILY))
    assert len(daily) == 217
    for k, sub in enumerate(subs):
        before = (k - 1) % 7 + 1
        assert daily[(sub, 2)] == pytest.approx(2 * 1.5 * (k + 1 - before))
    for d in range(1, 32):
        assert sum(v for (_, day_), v in daily.items() if day_ == d) == pytest.approx(0)
    monthly = by_sub(aggregate_interchange(df, MONTHLY))
    assert monthly["S"] == pytest.approx(16 * 1.5 * 1 / 2)


def test_session_time_zone_does_not_change_groups(spark, workdir):
    """Instants with an offset group the same under any session zone; the
    test tables' zone-less timestamps give identical rows."""
    from pyspark.sql import functions as F

    from conftest import SF_SMALL
    from gridload.plans.queries import load_daily

    gen = read_generation(spark, write(workdir, "g.csv", GENERATION_CSV))
    res = read_resources(spark, write(workdir, "r.csv", RESOURCES_CSV))
    inter = read_interchange(spark, write(workdir, "i.csv", INTERCHANGE_CSV))

    def epochs(df):
        return sorted((r.subsistema, r.t, r.valor) for r in
                      df.select("subsistema", F.unix_timestamp("data").alias("t"), "valor").collect())

    old = spark.conf.get("spark.sql.session.timeZone")
    utc = epochs(regional_load(gen, inter, res, DAILY))
    utc_rows = sorted(map(tuple, load_daily(spark, SF_SMALL).collect()))
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
        assert epochs(regional_load(gen, inter, res, DAILY)) == utc
        assert sorted(map(tuple, load_daily(spark, SF_SMALL).collect())) == utc_rows
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_unchecked_mode_gives_same_load(tables):
    gen, inter, res = tables
    assert by_day(regional_load(gen, inter, res, DAILY, None)) == pytest.approx(LOAD_DAILY)
    assert by_sub(regional_load(gen, inter, res, MONTHLY, None)) == pytest.approx(LOAD_MONTHLY)
