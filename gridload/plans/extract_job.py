"""The extraction job: one month of interchange and generation plus the plant
catalog, from partitioned catalog tables to header ``;`` CSV directories that
:func:`gridload.plans.load_job.run_load_job` reads directly.

Partition filters prune the month at planning time (with ``--periods``, several
months at run time); each output is written in
parallel, one file per task.

Command line::

    python -m gridload.plans.extract_job --interchange db.interchange_table \
        --generation db.generation_table --resources db.plant_table \
        --year 2018 --month 1 --out /shared/extract
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from ..schemas import GENERATION, INTERCHANGE, RESOURCES
from ..session import job_description
from ..sources.extract import (DAILY_PERIOD, GENERATION_CLASS, INTERCHANGE_CLASS,
                               extract_generation, extract_interchange, extract_resources)
from ..sources.sinks import write_csv


def _frame(spark: SparkSession, source: DataFrame | str) -> DataFrame:
    return spark.table(source) if isinstance(source, str) else source


def extract_frames(spark: SparkSession, interchange: DataFrame | str,
                   generation: DataFrame | str, resources: DataFrame | str,
                   year: int | str | None, month: int | str | None, period: str = DAILY_PERIOD,
                   interchange_class: str = INTERCHANGE_CLASS,
                   generation_class: str = GENERATION_CLASS,
                   periods: DataFrame | None = None) -> dict[str, DataFrame]:
    """The three extracts, lazily. Sources are frames or names of tables;
    ``periods``, a table of years and months, takes the place of the one month."""
    return {
        INTERCHANGE: extract_interchange(_frame(spark, interchange), year, month, period,
                                         interchange_class, periods),
        GENERATION: extract_generation(_frame(spark, generation), year, month, period,
                                       generation_class, periods),
        RESOURCES: extract_resources(_frame(spark, resources)),
    }


def run_extract_job(spark: SparkSession, interchange: DataFrame | str,
                    generation: DataFrame | str, resources: DataFrame | str,
                    year: int | str | None, month: int | str | None, out_dir: str, sep: str = ";",
                    mode: str = "errorifexists", period: str = DAILY_PERIOD,
                    interchange_class: str = INTERCHANGE_CLASS,
                    generation_class: str = GENERATION_CLASS,
                    periods: DataFrame | None = None) -> dict[str, str]:
    """Write the three extracts under ``out_dir``; returns name -> path. With
    ``periods`` (a table of years and months) year and month may be None."""
    base = out_dir.rstrip("/")
    frames = extract_frames(spark, interchange, generation, resources, year, month, period,
                            interchange_class, generation_class, periods)
    what = f"{year}-{month}" if periods is None else "listed periods"
    paths = {}
    for name, df in frames.items():
        with job_description(spark, f"gridload extract {what}: {name}"):
            paths[name] = write_csv(df, f"{base}/{name}", sep=sep, mode=mode)
    return paths


def main(argv: list[str] | None = None) -> dict[str, str]:
    from ..session import build_session

    p = argparse.ArgumentParser(description="Extract one month to CSV")
    p.add_argument("--interchange", required=True)
    p.add_argument("--generation", required=True)
    p.add_argument("--resources", required=True)
    p.add_argument("--year")
    p.add_argument("--month")
    p.add_argument("--periods", help="table of wanted years and months, instead of one month")
    p.add_argument("--out", required=True)
    p.add_argument("--sep", default=";")
    p.add_argument("--mode", default="errorifexists")
    p.add_argument("--master", default="local[*]")
    a = p.parse_args(argv)
    if (a.periods is None) == (a.year is None or a.month is None):
        p.error("give either --year and --month or --periods")
    spark = build_session(a.master)
    paths = run_extract_job(spark, a.interchange, a.generation, a.resources, a.year, a.month,
                            a.out, a.sep, a.mode,
                            periods=spark.table(a.periods) if a.periods else None)
    print(json.dumps(paths))
    return paths


if __name__ == "__main__":
    main()
