"""Electric load = generation - net interchange, per subsystem[, instant].

Both inputs are already aggregated, so they hold one row per key; the inner
join cannot fan out. A subsystem or instant present on one side only is
dropped. Both aggregates are already hash-partitioned on the join keys (same
keys, same order), so a sort-merge join runs on those partitions with no
further shuffle. The join is hinted as such: left to itself, AQE would collect
one side to the driver and broadcast it, which costs extra jobs and only pays
off when the sides are not already co-partitioned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import VALUE, group_keys
from .aggregate import aggregate_generation, aggregate_interchange
from .joins import DEFAULT_BROADCAST_MAX_BYTES, DEFAULT_BROADCAST_MAX_ROWS

_INTERCHANGE = "_valor_intercambio"


def compute_load(generation_aggr: DataFrame, interchange_aggr: DataFrame,
                 unit: str) -> DataFrame:
    """Columns: ``subsistema``[, ``data``], ``valor``."""
    keys = group_keys(unit)
    i = interchange_aggr.withColumnRenamed(VALUE, _INTERCHANGE)
    return (generation_aggr.hint("merge").join(i, on=keys, how="inner")
            .select(*keys, (F.col(VALUE) - F.col(_INTERCHANGE)).alias(VALUE)))


def regional_load(generation: DataFrame, interchange: DataFrame, resources: DataFrame,
                  unit: str, broadcast_max_rows: int | None = DEFAULT_BROADCAST_MAX_ROWS,
                  broadcast_max_bytes: int = DEFAULT_BROADCAST_MAX_BYTES) -> DataFrame:
    """Aggregate both sides, then subtract: the whole load calculation as one
    lazy plan (no view, no action besides the dimension size check)."""
    g = aggregate_generation(generation, resources, unit, broadcast_max_rows,
                             broadcast_max_bytes)
    i = aggregate_interchange(interchange, unit)
    return compute_load(g, i, unit)

