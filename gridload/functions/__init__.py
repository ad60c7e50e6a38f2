"""Column expressions (JVM-side, codegen'd)."""

from .casts import cast_string, cast_timestamp, to_instant, to_text
from .measures import mean_of_parts, row_mean, total

__all__ = ["cast_string", "cast_timestamp", "to_instant", "to_text", "mean_of_parts",
           "row_mean", "total"]
