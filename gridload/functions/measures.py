"""Aggregate expressions for the measure column.

The sum is taken in the input's own type and only then cast to double. With
DECIMAL input the result is exact and independent of task order; with double
input it is the same as ``sum``. The monthly mean is the pooled mean of rows,
``sum / count`` of non-NULL values, which equals ``avg`` for doubles.

Both are algebraic, so Spark runs them as partial (map-side) plus final
aggregates and a hot key never gathers its rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c).cast("double")


def row_mean(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    n = F.count(c)
    return F.when(n > 0, F.sum(c).cast("double") / n)


def mean_of_parts(part_sum: Column | str, part_count: Column | str) -> Column:
    """Pooled mean from partial (sum, count) pairs; equal to ``row_mean`` of
    the rows the parts came from."""
    s = F.col(part_sum) if isinstance(part_sum, str) else part_sum
    n = F.sum(F.col(part_count) if isinstance(part_count, str) else part_count)
    return F.when(n > 0, F.sum(s).cast("double") / n)
