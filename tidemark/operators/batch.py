"""Many requests at once: a table of requests joined with the series, one job in place of one for each.

``requests`` holds request_id (any type), vin, lo and hi (long, milliseconds, lo < hi), for the downsample
also interval. Up to ``BROADCAST_ROWS`` requests are fetched, made once, and broadcast; more are joined by shuffle on
the key, where the adaptive skew join splits a crowded series.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import filtered
from ..sources.adapters import Series, last_of
from ..types import Aggregator, CompareExpression

BROADCAST_ROWS = 100_000


def _met(series: Series, requests: DataFrame, columns: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    asked = requests.select("request_id", F.col("vin").alias("asked"), F.col("lo").cast("long"), F.col("hi").cast("long"), *more)
    few = asked.limit(BROADCAST_ROWS + 1).toArrow()
    if few.num_rows <= BROADCAST_ROWS:
        asked = F.broadcast(asked.sparkSession.createDataFrame(few, asked.schema))
    order = [F.col(c).alias(f"_{n}") for n, c in enumerate(series.tie)] if series.dedup else []
    rows = replace(series, dedup=False).frame(series.df, columns, order)
    met = rows.join(asked, (F.col("vin") == F.col("asked")) & (F.col("ts") >= F.col("lo")) & (F.col("ts") < F.col("hi")))
    return last_of(met, ["request_id", "vin", "lo", "hi", "ts"], [f"_{n}" for n in range(len(order))]) if order else met


def range_batch(series: Series, requests: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """request_id, vin, ts and columns of every row that a request asks for."""
    names = series.schema.chosen(columns)
    return _met(series, requests, names).select("request_id", "vin", "ts", *names)


def aggregate_batch(series: Series, requests: DataFrame, column: str, aggregator: Aggregator, test: CompareExpression | None = None, sentinel: str = "reference") -> DataFrame:
    """request_id, vin, ts = lo and the aggregate of each request whose range holds any row."""
    value = filtered(F.col(column), series.schema.numeric(column), aggregator, test, sentinel).alias(column)
    return _met(series, requests, [column]).groupBy("request_id", "vin", F.col("lo").alias("from")).agg(value).select("request_id", "vin", F.col("from").alias("ts"), column)


def downsample_batch(series: Series, requests: DataFrame, column: str, aggregator: Aggregator, test: CompareExpression | None = None, sentinel: str = "reference") -> DataFrame:
    """request_id, vin, ts = bucket's begin and the aggregate of each bucket of each request that holds any row."""
    value = filtered(F.col(column), series.schema.numeric(column), aggregator, test, sentinel).alias(column)
    since = F.col("ts") - F.col("lo")
    return _met(series, requests, [column], ["interval"]).groupBy("request_id", "vin", (F.col("lo") + since - since % F.col("interval")).alias("start")).agg(value).select("request_id", "vin", F.col("start").alias("ts"), column)
