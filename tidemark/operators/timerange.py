"""All rows of a series in a half-open time range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..sources.adapters import Series
from ..types import check_range


def time_range(series: Series, lo: int, hi: int, vins: Sequence[str] | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """vin, ts and columns of the rows with lo <= ts < hi, in no order. A scan with pushed filters, no shuffle."""
    check_range(lo, hi)
    return series.frame(series.within(series.only(vins), lo, hi), series.schema.chosen(columns))
