"""AVG or MAX of a column over a time range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import filtered
from ..sources.adapters import Series
from ..types import Aggregator, CompareExpression
from .timerange import time_range


def aggregate(series: Series, column: str, aggregator: Aggregator, lo: int, hi: int, vins: Sequence[str] | None = None, test: CompareExpression | None = None, sentinel: str = "reference") -> DataFrame:
    """A row (vin, ts = lo, column) for each series with any row in the range; none for others.

    Partial sums or maxima are made before the shuffle, one row of each series and task.
    """
    kind = series.schema.numeric(column)
    rows = time_range(series, lo, hi, vins, [column])
    return rows.groupBy("vin").agg(filtered(F.col(column), kind, aggregator, test, sentinel).alias(column)).select("vin", F.lit(lo).cast("long").alias("ts"), column)
