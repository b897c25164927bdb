"""AVG or MAX of a column in each fixed time bucket, with a filter on the values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bucket_start, filtered
from ..sources.adapters import Series
from ..types import Aggregator, CompareExpression, check_interval
from .timerange import time_range


#: Buckets that a row of the grid of all buckets is made of.
GRID = 4096


def downsample(
    series: Series, column: str, aggregator: Aggregator, lo: int, hi: int, interval: int, test: CompareExpression | None = None,
    vins: Sequence[str] | None = None, sentinel: str = "reference", emit_empty_buckets: bool = False,
) -> DataFrame:
    """A row (vin, ts = bucket's begin, column) for each bucket that holds any row; buckets begin at ``lo``.

    The filter says which values the aggregate takes in, never which buckets there are: a bucket whose
    values all fail has the sentinel. With ``emit_empty_buckets``, a series with any row in the range has all buckets.
    """
    check_interval(lo, hi, interval)
    kind = series.schema.numeric(column)
    rows = time_range(series, lo, hi, vins, [column])
    value = filtered(F.col(column), kind, aggregator, test, sentinel).alias(column)
    out = rows.groupBy("vin", bucket_start(F.col("ts"), lo, interval).alias("ts")).agg(value).select("vin", "ts", column)
    if not emit_empty_buckets:
        return out
    none = F.lit(None if sentinel == "null" else kind.no_value if aggregator is Aggregator.MAX else float("-inf")).cast(out.schema[column].dataType)
    span, many = GRID * interval, (hi - lo) // interval  # in two steps, so that no row holds more than so many buckets
    runs = out.select("vin").distinct().select("vin", F.explode(F.sequence(F.lit(0), F.lit((many - 1) // GRID))).alias("run"))
    begin = F.lit(lo).cast("long") + F.col("run") * F.lit(span).cast("long")
    grid = runs.select("vin", F.explode(F.sequence(begin, F.least(begin + F.lit(span - interval).cast("long"), F.lit(hi - interval).cast("long")), F.lit(interval).cast("long"))).alias("ts"))
    return grid.join(out, ["vin", "ts"], "left").select("vin", "ts", F.when(F.col(column).isNull(), none).otherwise(F.col(column)).alias(column))
