"""Column expressions: filtered aggregates and time buckets."""

from .aggregates import filtered, passes
from .time import bucket_start, millis, moment

__all__ = ["bucket_start", "filtered", "millis", "moment", "passes"]
