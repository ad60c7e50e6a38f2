"""Stage metrics: record count and highest value of each intermediate result.

The generation aggregate, the interchange aggregate and the load are measured
on one join: a full outer merge join of the two aggregates, where presence
flags tell the sides apart. An ``Observation`` on an aggregate *below* an inner
join would not do: a sort-merge join stops reading one side when the other is
at its end, so rows without a partner would go uncounted.

* :func:`observed_load` is the load with such an ``Observation``: the action
  that writes the load fills the metrics, and nothing is evaluated twice.
* :func:`load_stage_summary` is the same numbers as a DataFrame.

:func:`metric_rows` turns a stage's measurements into long-format rows
(``run_id, stage, recorded_at, metric, value, text``) of a Parquet table.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import VALUE, group_keys

STAGE = "stage"
RECORD_COUNT = "record_count"
MAX_VALUE = "max_valor"

# Stage names of the load job.
STAGE_LOAD_DATA = "load_data"
STAGE_INITIAL_STATS = "initial_data_stats"
STAGE_PROCESS = "process_data"
STAGE_TO_LIST = "convert_data_to_list"
STAGE_GENERATION = "aggreg_geracao"
STAGE_INTERCHANGE = "aggreg_intercambio"
STAGE_LOAD = "calculate_carga"
STAGE_START = "start_job"
STAGE_END = "end_job"

METRICS_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField(STAGE, T.StringType(), False),
    T.StructField("recorded_at", T.TimestampType(), False),
    T.StructField("metric", T.StringType(), False),
    T.StructField("value", T.DoubleType(), True),
    T.StructField("text", T.StringType(), True),
])


def _both_sides(generation_aggr: DataFrame, interchange_aggr: DataFrame,
                unit: str) -> DataFrame:
    """The aggregates side by side, one row for each key of either: values
    ``_g`` and ``_i``, presence flags ``_gp`` and ``_ip``. Both are partitioned
    on the keys already, so the join adds no shuffle."""
    keys = group_keys(unit)
    g = generation_aggr.select(*keys, F.col(VALUE).alias("_g"), F.lit(True).alias("_gp"))
    i = interchange_aggr.select(*keys, F.col(VALUE).alias("_i"), F.lit(True).alias("_ip"))
    return g.hint("merge").join(i, on=keys, how="full_outer")


def _measures() -> list:
    matched = F.col("_gp") & F.col("_ip")
    return [F.count(F.when(F.col("_gp"), 1)).alias("gn"), F.max("_g").alias("gm"),
            F.count(F.when(F.col("_ip"), 1)).alias("in"), F.max("_i").alias("im"),
            F.count(F.when(matched, 1)).alias("cn"),
            F.max(F.when(matched, F.col("_g") - F.col("_i"))).alias("cm")]


_STAGES = ((STAGE_GENERATION, "gn", "gm"), (STAGE_INTERCHANGE, "in", "im"),
           (STAGE_LOAD, "cn", "cm"))


def observed_load(generation_aggr: DataFrame, interchange_aggr: DataFrame,
                  unit: str) -> tuple[DataFrame, Observation]:
    """The load (as :func:`~gridload.operators.load.compute_load` gives it) and
    the observation that the first action on it fills; see :func:`stage_values`."""
    seen = Observation("load_stages")
    both = _both_sides(generation_aggr, interchange_aggr, unit).observe(seen, *_measures())
    load = both.where(F.col("_gp") & F.col("_ip")).select(
        *group_keys(unit), (F.col("_g") - F.col("_i")).alias(VALUE))
    return load, seen


def stage_values(seen: Observation) -> dict[str, dict]:
    """``{stage: {record_count, max_valor}}`` of a filled observation."""
    values = seen.get
    return {stage: {RECORD_COUNT: values[n], MAX_VALUE: values[m]} for stage, n, m in _STAGES}


def load_stage_summary(generation_aggr: DataFrame, interchange_aggr: DataFrame,
                       unit: str) -> DataFrame:
    """Rows ``(stage, record_count, max_valor)`` for the generation aggregate,
    the interchange aggregate and the load, from one pass over the join that
    the job observes."""
    totals = _both_sides(generation_aggr, interchange_aggr, unit).agg(*_measures())
    rows = [F.struct(F.lit(stage).alias(STAGE), F.col(n).alias(RECORD_COUNT),
                     F.col(m).alias(MAX_VALUE)) for stage, n, m in _STAGES]
    return totals.select(F.inline(F.array(*rows)))


def metric_rows(run_id: str, stage: str, values: dict) -> list[tuple]:
    """Long-format rows for one stage, stamped now (call it when the stage
    ends): numbers go to ``value``, anything else (subsystem names, units, file
    lists) to ``text``."""
    now = _dt.datetime.now(_dt.timezone.utc)
    rows = []
    for metric, v in values.items():
        if v is None:
            rows.append((run_id, stage, now, metric, None, None))
        elif isinstance(v, (bool, int, float)):
            rows.append((run_id, stage, now, metric, float(v), None))
        elif isinstance(v, (list, tuple)):
            rows.append((run_id, stage, now, metric, None, ";".join(map(str, v))))
        else:
            rows.append((run_id, stage, now, metric, None, str(v)))
    return rows
