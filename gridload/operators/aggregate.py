"""Generation and interchange aggregates (per subsystem, daily or monthly).

Generation is a fact table joined to the plant -> subsystem dimension on the
plant guid (inner: generation of an unknown plant is dropped; a guid listed
twice counts its generation twice). Two physical shapes, same result:

* dimension proven small -> broadcast hash join, then partial + final
  aggregate. The fact side is never shuffled; only the (subsystem[, instant])
  partial sums cross the network.
* dimension too large to broadcast -> aggregate generation per
  (plant[, instant]) first, then shuffle-join that to the dimension and
  aggregate again. A plant holding a third of all rows arrives at the join as
  one row per instant, not as a third of the data in one partition. The join
  is pinned to sort-merge: neither side has a proven size bound here, so
  neither is broadcast on an optimizer estimate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import mean_of_parts, row_mean, total
from ..schemas import (DAILY, PLANT_GUID, RESOURCE_GUID, SUBSYSTEM, VALUE, check_unit,
                       group_keys)
from .joins import (DEFAULT_BROADCAST_MAX_BYTES, DEFAULT_BROADCAST_MAX_ROWS, bounded_broadcast,
                    size_measures)

_PART_SUM = "_valor_sum"
_PART_COUNT = "_valor_count"


def _plant_dimension(resources: DataFrame) -> DataFrame:
    return resources.select(RESOURCE_GUID, SUBSYSTEM)


def dimension_measures(resources: DataFrame) -> DataFrame:
    """One row (n, b): rows and bytes of the plant dimension."""
    dim = _plant_dimension(resources)
    return dim.agg(*size_measures(dim))


def attach_subsystem(generation: DataFrame, resources: DataFrame,
                     broadcast_max_rows: int | None = DEFAULT_BROADCAST_MAX_ROWS,
                     broadcast_max_bytes: int = DEFAULT_BROADCAST_MAX_BYTES) -> DataFrame:
    """Generation rows with the ``subsistema`` of their plant (inner join on
    ``guid_usina = guid_recurso``). Columns: generation's, then ``subsistema``.
    Over the bound the fact rows are shuffled by plant; a hot plant's partition
    is then split by adaptive execution, which must be on."""
    dim, small = bounded_broadcast(_plant_dimension(resources), broadcast_max_rows,
                                   broadcast_max_bytes)
    fact = generation if small else generation.hint("merge")
    joined = fact.join(dim, fact[PLANT_GUID] == dim[RESOURCE_GUID], "inner")
    return joined.select(*[fact[c] for c in generation.columns], dim[SUBSYSTEM])


def _measure(unit: str, value: str = VALUE):
    return total(value) if unit == DAILY else row_mean(value)


def aggregate_generation(generation: DataFrame, resources: DataFrame, unit: str,
                         broadcast_max_rows: int | None = DEFAULT_BROADCAST_MAX_ROWS,
                         broadcast_max_bytes: int = DEFAULT_BROADCAST_MAX_BYTES,
                         dimension_size: tuple[int, int] | None = None) -> DataFrame:
    """Generation per subsystem: ``sum`` per (subsystem, instant) for
    ``diario``, mean of rows per subsystem for ``mensal``. ``dimension_size``
    is the plant dimension's size where it was measured before
    (:func:`dimension_measures`). Which path is taken changes the plan only;
    sums of doubles may differ in the last digit between the two.

    Columns: ``subsistema``[, ``data``], ``valor`` (double).
    """
    keys = group_keys(unit)
    dim, small = bounded_broadcast(_plant_dimension(resources), broadcast_max_rows,
                                   broadcast_max_bytes, dimension_size)
    if small:
        joined = generation.join(dim, generation[PLANT_GUID] == dim[RESOURCE_GUID], "inner")
        return joined.groupBy(*[dim[SUBSYSTEM] if k == SUBSYSTEM else generation[k]
                                for k in keys]).agg(_measure(unit).alias(VALUE))

    plant_keys = [PLANT_GUID] + [k for k in keys if k != SUBSYSTEM]
    parts = (generation.where(F.col(PLANT_GUID).isNotNull())
             .groupBy(*plant_keys)
             .agg(F.sum(VALUE).alias(_PART_SUM), F.count(VALUE).alias(_PART_COUNT)))
    joined = parts.hint("merge").join(dim, parts[PLANT_GUID] == dim[RESOURCE_GUID], "inner")
    measure = (F.sum(_PART_SUM).cast("double") if unit == DAILY
               else mean_of_parts(_PART_SUM, _PART_COUNT))
    return joined.groupBy(*[dim[SUBSYSTEM] if k == SUBSYSTEM else parts[k]
                            for k in keys]).agg(measure.alias(VALUE))


def aggregate_interchange(interchange: DataFrame, unit: str) -> DataFrame:
    """Interchange per subsystem, same units and columns as
    :func:`aggregate_generation`."""
    keys = group_keys(check_unit(unit))
    return interchange.groupBy(*keys).agg(_measure(unit).alias(VALUE))

