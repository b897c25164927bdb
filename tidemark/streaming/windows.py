"""Tumbling downsample over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import filtered
from ..types import Aggregator, ColumnType, CompareExpression


def downsample_stream(stream: DataFrame, column: str, kind: ColumnType, aggregator: Aggregator, lo: int, interval: int, watermark: int, test: CompareExpression | None = None) -> DataFrame:
    """vin, ts = bucket's begin and the aggregate over a stream of (vin, ts, column), buckets anchored at ``lo``.

    A bucket is final once the newest time is ``watermark`` milliseconds past its end; rows later than that are
    dropped, unlike in batch. Rows before ``lo`` are left out.
    """
    at = F.timestamp_millis("ts")
    window = F.window("at", f"{interval} milliseconds", None, f"{lo % interval} milliseconds")
    rows = stream.where(F.col("ts") >= lo).withColumn("at", at).withWatermark("at", f"{watermark} milliseconds")
    out = rows.groupBy("vin", window.alias("w")).agg(filtered(F.col(column), kind, aggregator, test).alias(column))
    return out.select("vin", F.unix_millis("w.start").alias("ts"), column)
