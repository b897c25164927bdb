"""The newest row of each series."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import millis
from ..sources.adapters import Series


def latest(series: Series, vins: Sequence[str] | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """vin, ts and columns of the newest row of each series asked for (None: all), one row each.

    Unknown series are left out, and one asked for twice comes once. Of rows with the same newest time
    the first by the series' tie order wins, or the last if only the last counts. The row number is limited before the shuffle: a task sends one
    row of each series that it has met, so a series that holds a third of all rows costs no more than others.
    Values are made of the raw columns of the winners alone.
    """
    names = series.schema.chosen(columns)
    order = Window.partitionBy(series.key).orderBy(millis(F.col(series.time), series.stored).desc(), *(map(F.desc, series.tie) if series.dedup else series.tie))
    newest = series.only(vins).withColumn("place", F.row_number().over(order)).where("place = 1")
    return replace(series, dedup=False).frame(newest, names)
