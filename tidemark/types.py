"""Types, sentinels and requests of the engine, all validated when made or used."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import types as T

# What stands for "no value" in an aggregate whose filter lets nothing pass, by bits
# 0xfff0000000000000 (minus infinity) and 0x80000000, and the width of a series key.
NO_DOUBLE = float("-inf")
NO_INTEGER = -2147483648
VIN_BYTES = 17

#: Columns that tables have beside the value columns.
RESERVED = ("vin", "ts", "append", "bucket", "written", "nth")
INT_MIN, INT_MAX = -(2**31), 2**31 - 1
LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


class ColumnType(Enum):
    """Types of a value column."""

    STRING = 1
    INTEGER = 2
    DOUBLE_FLOAT = 3

    @property
    def spark(self) -> T.DataType:
        return {ColumnType.STRING: T.StringType(), ColumnType.INTEGER: T.IntegerType(), ColumnType.DOUBLE_FLOAT: T.DoubleType()}[self]

    @property
    def no_value(self) -> float | int | None:
        return {ColumnType.STRING: None, ColumnType.INTEGER: NO_INTEGER, ColumnType.DOUBLE_FLOAT: NO_DOUBLE}[self]

    def check(self, value: object, what: str) -> None:
        """Raise unless a value is of this type; whole numbers are doubles too, truth values are neither."""
        fits = {
            ColumnType.STRING: isinstance(value, str),
            ColumnType.INTEGER: isinstance(value, int) and not isinstance(value, bool) and INT_MIN <= value <= INT_MAX,
            ColumnType.DOUBLE_FLOAT: isinstance(value, int | float) and not isinstance(value, bool),
        }[self]
        if not fits:
            raise TypeError(f"{what} takes {self.name}, not {value!r}")

    @classmethod
    def of(cls, kind: T.DataType) -> ColumnType:
        for t in cls:
            if t.spark == kind:
                return t
        raise TypeError(f"no column type for {kind.simpleString()}")


class Aggregator(Enum):
    AVG = 1
    MAX = 2


class CompareOp(Enum):
    EQUAL = 1
    GREATER = 2


@dataclass(frozen=True)
class CompareExpression:
    """``column op value``: which values an aggregate takes in."""

    value: float | int
    op: CompareOp


@dataclass(frozen=True)
class Schema:
    """Value columns by name; they are kept in name order."""

    columns: Mapping[str, ColumnType]

    def __post_init__(self) -> None:
        if not self.columns:
            raise ValueError("a schema needs a column")
        for name, kind in self.columns.items():
            if name in RESERVED or not name:
                raise ValueError(f"a value column can't be named {name!r}")
            if not isinstance(kind, ColumnType):
                raise TypeError(f"{name}: {kind!r} is no ColumnType")
        object.__setattr__(self, "columns", dict(sorted(self.columns.items())))

    def struct(self) -> T.StructType:
        fields = [T.StructField("vin", T.StringType(), False), T.StructField("ts", T.LongType(), False)]
        return T.StructType(fields + [T.StructField(n, t.spark, False) for n, t in self.columns.items()])

    @classmethod
    def of(cls, struct: T.StructType) -> Schema:
        return cls({f.name: ColumnType.of(f.dataType) for f in struct.fields if f.name not in RESERVED})

    def chosen(self, names: Sequence[str] | None) -> list[str]:
        """Requested columns in name order; none requested means all."""
        unknown = sorted(set(names or ()) - set(self.columns))
        if unknown:
            raise KeyError(f"no such column: {', '.join(unknown)}")
        return sorted(set(names)) if names else list(self.columns)

    def numeric(self, name: str) -> ColumnType:
        """The type of a column that can be aggregated."""
        kind = self.columns[self.chosen([name])[0]]
        if kind is ColumnType.STRING:
            raise TypeError(f"column {name} holds strings, which have no average or maximum here")
        return kind


def check_vin(vin: object) -> str:
    if not isinstance(vin, str) or not 1 <= len(vin.encode()) <= VIN_BYTES:
        raise ValueError(f"a series key is a string of 1 to {VIN_BYTES} bytes, not {vin!r}")
    return vin


def check_range(lo: int, hi: int) -> None:
    for x in (lo, hi):
        if not isinstance(x, int) or isinstance(x, bool) or not LONG_MIN <= x <= LONG_MAX:
            raise TypeError(f"a time bound is a 64-bit integer of milliseconds, not {x!r}")
    if lo >= hi:
        raise ValueError(f"the lower bound {lo} isn't below the upper bound {hi}")


def check_interval(lo: int, hi: int, interval: int) -> None:
    check_range(lo, hi)
    if not isinstance(interval, int) or isinstance(interval, bool) or interval <= 0:
        raise ValueError(f"an interval is a positive number of milliseconds, not {interval!r}")
    if (hi - lo) % interval:
        raise ValueError(f"the interval {interval} doesn't divide the range {lo} to {hi}")


@dataclass(frozen=True)
class Row:
    """A row: its key is (vin, timestamp), its values are one for each column."""

    vin: str
    timestamp: int
    columns: Mapping[str, object]


@dataclass(frozen=True)
class WriteRequest:
    table_name: str
    rows: Sequence[Row]


@dataclass(frozen=True)
class LatestQueryRequest:
    table_name: str
    vins: Sequence[str]
    requested_columns: Sequence[str] = ()

    def __post_init__(self) -> None:
        for vin in self.vins:
            check_vin(vin)


@dataclass(frozen=True)
class TimeRangeQueryRequest:
    table_name: str
    vin: str
    time_lower_bound: int
    time_upper_bound: int
    requested_columns: Sequence[str] = ()

    def __post_init__(self) -> None:
        check_vin(self.vin)
        check_range(self.time_lower_bound, self.time_upper_bound)


@dataclass(frozen=True)
class TimeRangeAggregationRequest:
    table_name: str
    vin: str
    column_name: str
    time_lower_bound: int
    time_upper_bound: int
    aggregator: Aggregator

    def __post_init__(self) -> None:
        check_vin(self.vin)
        check_range(self.time_lower_bound, self.time_upper_bound)


@dataclass(frozen=True)
class TimeRangeDownsampleRequest:
    table_name: str
    vin: str
    column_name: str
    time_lower_bound: int
    time_upper_bound: int
    aggregator: Aggregator
    interval: int
    column_filter: CompareExpression | None = field(default=None)

    def __post_init__(self) -> None:
        check_vin(self.vin)
        check_interval(self.time_lower_bound, self.time_upper_bound, self.interval)
