"""Time-series analytics on PySpark: wide telemetry tables keyed by series and millisecond timestamp."""

from .engine import Engine
from .types import (
    Aggregator,
    ColumnType,
    CompareExpression,
    CompareOp,
    LatestQueryRequest,
    Row,
    Schema,
    TimeRangeAggregationRequest,
    TimeRangeDownsampleRequest,
    TimeRangeQueryRequest,
    WriteRequest,
)

__all__ = [
    "Aggregator", "ColumnType", "CompareExpression", "CompareOp", "Engine", "LatestQueryRequest", "Row", "Schema",
    "TimeRangeAggregationRequest", "TimeRangeDownsampleRequest", "TimeRangeQueryRequest", "WriteRequest",
]
