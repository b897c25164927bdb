"""Pre-aggregates: count, sum and maximum of columns in each block of time, and aggregates that use them.

A rollup has vin, block_start (a multiple of the block's milliseconds) and for each numeric column ``n_``, ``total_`` and
``most_``: the number of values that aren't null, their sum as a double, and their maximum by the rule of ``filtered`` (NaN
only where there is nothing else). A block may have several rows, say one of each append: counts and sums add up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bucket_start, filtered
from ..operators.timerange import time_range
from ..sources.adapters import Series
from ..types import NO_DOUBLE, Aggregator, ColumnType, check_interval, check_range


def build_rollup(series: Series, columns: Sequence[str], block: int) -> DataFrame:
    """The rollup of a series' columns: one row of each series and block, with partial aggregates before the shuffle."""
    kinds = {c: series.schema.numeric(c) for c in columns}
    rows = series.frame(series.df, list(columns))
    start = F.col("ts") - F.pmod(F.col("ts"), F.lit(block).cast("long"))
    made = []
    for c, kind in kinds.items():
        made += [F.count(c).alias(f"n_{c}"), F.sum(F.col(c).cast("double")).alias(f"total_{c}"), filtered(F.col(c), kind, Aggregator.MAX, sentinel="null").alias(f"most_{c}")]
    return rows.groupBy("vin", start.alias("block_start")).agg(*made)


def _parts(series: Series, rollup: DataFrame, column: str, block: int, lo: int, hi: int, vins: Sequence[str] | None) -> DataFrame:
    """vin, ts, n, total, most over [lo, hi): whole blocks from the rollup, the edges from the rows."""
    first, last = -(-lo // block) * block, hi // block * block
    value = F.col(column)

    def raw(a: int, b: int) -> DataFrame:
        return time_range(series, a, b, vins, [column]).select("vin", "ts", F.when(value.isNotNull(), 1).otherwise(0).cast("long").alias("n"), value.cast("double").alias("total"), value.alias("most"))

    if first >= last:
        return raw(lo, hi)
    whole = rollup.where((F.col("block_start") >= first) & (F.col("block_start") < last))
    whole = whole if vins is None else whole.where(F.col("vin").isin(list(vins)))
    out = whole.select("vin", F.col("block_start").alias("ts"), F.col(f"n_{column}").alias("n"), F.col(f"total_{column}").alias("total"), F.col(f"most_{column}").alias("most"))
    for a, b in ((lo, first), (last, hi)):
        out = out.union(raw(a, b)) if a < b else out
    return out


def _final(aggregator: Aggregator, kind: ColumnType, sentinel: str) -> Column:
    if aggregator is Aggregator.MAX:
        return filtered(F.col("most"), kind, Aggregator.MAX, sentinel=sentinel)
    mean = F.try_divide(F.sum("total"), F.sum("n"))
    return mean if sentinel == "null" else F.coalesce(mean, F.lit(NO_DOUBLE))


def aggregate_with_rollup(series: Series, rollup: DataFrame, column: str, block: int, aggregator: Aggregator, lo: int, hi: int, vins: Sequence[str] | None = None, sentinel: str = "reference") -> DataFrame:
    """The same rows as ``aggregate`` without a filter, reading raw rows at the edges of the range only."""
    check_range(lo, hi)
    kind = series.schema.numeric(column)
    return _parts(series, rollup, column, block, lo, hi, vins).groupBy("vin").agg(_final(aggregator, kind, sentinel).alias(column)).select("vin", F.lit(lo).cast("long").alias("ts"), column)


def fits_blocks(block: int, lo: int, interval: int) -> bool:
    """Whether every bucket begins and ends with a block."""
    return lo % block == 0 and interval % block == 0


def downsample_with_rollup(series: Series, rollup: DataFrame, column: str, block: int, aggregator: Aggregator, lo: int, hi: int, interval: int, vins: Sequence[str] | None = None, sentinel: str = "reference") -> DataFrame:
    """The same rows as ``downsample`` without a filter, for buckets that begin and end with blocks."""
    check_interval(lo, hi, interval)
    if not fits_blocks(block, lo, interval):
        raise ValueError("bounds and interval must be multiples of the block")
    kind = series.schema.numeric(column)
    parts = _parts(series, rollup, column, block, lo, hi, vins)
    return parts.groupBy("vin", bucket_start(F.col("ts"), lo, interval).alias("start")).agg(_final(aggregator, kind, sentinel).alias(column)).select("vin", F.col("start").alias("ts"), column)
