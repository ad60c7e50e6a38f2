"""gridload: regional electric load (generation - net interchange) on Spark.

Subpackages:

* ``sources``   typed CSV readers, catalog views, period extraction, sinks,
                and the mapping of the test tables onto the domain tables
* ``functions`` column expressions: casts and the measure aggregates
* ``operators`` relational steps: aggregates, load, ranking, profile, metrics
* ``plans``     whole jobs (load, extraction) and the registered queries
* ``llm``       operations of a training-data pipeline (optional, see README)
"""

from .operators.aggregate import aggregate_generation, aggregate_interchange, attach_subsystem
from .operators.load import compute_load, regional_load
from .operators.rank import (load_positions, order_load, peak_load, peak_load_per_day,
                             top_loads)
from .operators.state import LoadState
from .plans.extract_job import run_extract_job
from .plans.load_job import run_load_job
from .schemas import DAILY, MONTHLY

__version__ = "0.1.0"

__all__ = [
    "DAILY", "MONTHLY", "attach_subsystem", "aggregate_generation", "aggregate_interchange",
    "compute_load", "regional_load", "order_load", "peak_load", "peak_load_per_day",
    "top_loads", "load_positions", "LoadState", "run_extract_job", "run_load_job",
]
