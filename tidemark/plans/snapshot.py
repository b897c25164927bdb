"""A table of the newest rows, kept up to date from new rows alone."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.latest import latest
from ..sources.adapters import Series
from ..types import Schema


def merge_latest(snapshot: DataFrame | None, new: Series) -> DataFrame:
    """The newest row of each series of a snapshot (vin, ts, columns) and of new rows; on equal times the snapshot's stays.

    Only the snapshot and the new rows are read, never the whole table.
    """
    fresh = latest(new)
    if snapshot is None:
        return fresh
    from pyspark.sql import functions as F

    names = list(new.schema.columns)
    both = snapshot.select("vin", "ts", *names, F.lit(0).alias("age")).union(fresh.select("vin", "ts", *names, F.lit(1)))
    return latest(Series(both, Schema(new.schema.columns), tie=("age",)))
