"""The engine: named tables in a folder, written by appends and asked by requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from . import operators, plans
from .sources.adapters import Series
from .sources.storage import BLOCK, BUCKETS, Store, Table
from .types import (
    LatestQueryRequest,
    Row,
    Schema,
    TimeRangeAggregationRequest,
    TimeRangeDownsampleRequest,
    TimeRangeQueryRequest,
    WriteRequest,
)


class Engine:
    """Tables of series under ``path``, a folder that must exist.

    ``buckets`` and ``block`` (milliseconds of a rollup's block) are those of tables that this engine makes; a table that is there
    keeps its own. ``dedup`` None keeps all rows of one (vin, ts), as the contract leaves them undefined, and of newest rows
    gives the first written; "last" keeps the one written last. ``sentinel`` is what an aggregate without any passing value gives: "reference" (minus infinity
    or the least integer) or "null". Requests may come from several threads. Results are DataFrames; ``rows`` turns one into rows.

    The newest rows come from the small tables of newest rows that appends keep. Aggregates without a filter, and downsamples
    whose buckets are whole blocks, take whole blocks from the rollups, unless ``dedup`` or ``stored_aggregates=False`` forbids it.
    ``stats`` counts, by table, the appends and rows that this engine has written and the bounds of their times.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, dedup: str | None = None, sentinel: str = "reference", block: int = BLOCK, stored_aggregates: bool = True):
        if dedup not in (None, "last"):
            raise ValueError(f"dedup is None or last, not {dedup!r}")
        self.spark, self.store, self.dedup, self.sentinel, self.stored_aggregates = spark, Store(spark, path, buckets, block), dedup, sentinel, stored_aggregates
        self.tables: dict[str, Table] | None = None
        self.stats: dict[str, dict[str, int]] = {}

    def connect(self) -> Engine:
        """Load what is in the folder; an empty folder is a new database. Nothing there is changed."""
        self.tables = self.store.tables()
        return self

    def shutdown(self) -> None:
        """Close the engine. Every write that returned is on disk already, so there is nothing to flush."""
        self.tables = None

    @property
    def schemas(self) -> dict[str, Schema] | None:
        return None if self.tables is None else {n: t.schema for n, t in self.tables.items()}

    def _table(self, table: str) -> Table:
        if self.tables is None:
            raise RuntimeError("the engine isn't connected")
        if table not in self.tables:
            raise KeyError(f"no table {table}")
        return self.tables[table]

    def create_table(self, table: str, schema: Schema) -> None:
        if self.tables is None:
            raise RuntimeError("the engine isn't connected")
        self.tables[table] = self.store.create(table, schema)

    def _append(self, table: str, df: DataFrame, mark: str | None = None) -> None:
        counted = self.store.append(table, self._table(table), df, mark)
        if counted and counted["rows"]:
            so_far = self.stats.setdefault(table, {"appends": 0, "rows": 0, "from": counted["from"], "to": counted["to"]})
            so_far.update({"appends": so_far["appends"] + 1, "rows": so_far["rows"] + counted["rows"], "from": min(so_far["from"], counted["from"]), "to": max(so_far["to"], counted["to"])})

    def write(self, request: WriteRequest) -> None:
        """Append complete rows, readable once this returns."""
        schema = self._table(request.table_name).schema
        if request.rows:
            self._append(request.table_name, self.store.rows_frame(request.rows, schema))

    def write_frame(self, table: str, df: DataFrame, mark: str | None = None) -> None:
        """Append a DataFrame of vin, ts and all columns, in the schema's types. A ``mark`` names the append: written again, it changes nothing."""
        self._append(table, self.store.checked_frame(df, self._table(table).schema), mark)

    def series(self, table: str) -> Series:
        return self.store.series(table, self._table(table), self.dedup)

    def execute_latest_query(self, request: LatestQueryRequest) -> DataFrame:
        return operators.latest(self.store.newest(request.table_name, self._table(request.table_name), self.dedup), request.vins, request.requested_columns)

    def execute_time_range_query(self, request: TimeRangeQueryRequest) -> DataFrame:
        return operators.time_range(self.series(request.table_name), request.time_lower_bound, request.time_upper_bound, [request.vin], request.requested_columns)

    def aggregate(self, r: TimeRangeAggregationRequest, vins: Sequence[str] | None) -> DataFrame:
        """An aggregation for some series, or with None for all; the request's own series counts no more."""
        series, table = self.series(r.table_name), self._table(r.table_name)
        series.schema.numeric(r.column_name)
        if self.stored_aggregates and self.dedup is None:
            return plans.aggregate_with_rollup(series, self.store.rollup(r.table_name, table), r.column_name, table.block, r.aggregator, r.time_lower_bound, r.time_upper_bound, vins, self.sentinel)
        return operators.aggregate(series, r.column_name, r.aggregator, r.time_lower_bound, r.time_upper_bound, vins, None, self.sentinel)

    def execute_aggregate_query(self, request: TimeRangeAggregationRequest) -> DataFrame:
        return self.aggregate(request, [request.vin])

    def downsample(self, r: TimeRangeDownsampleRequest, vins: Sequence[str] | None) -> DataFrame:
        """A downsample for some series, or with None for all; the request's own series counts no more."""
        series, table = self.series(r.table_name), self._table(r.table_name)
        series.schema.numeric(r.column_name)
        if self.stored_aggregates and self.dedup is None and r.column_filter is None and plans.fits_blocks(table.block, r.time_lower_bound, r.interval):
            return plans.downsample_with_rollup(series, self.store.rollup(r.table_name, table), r.column_name, table.block, r.aggregator, r.time_lower_bound, r.time_upper_bound, r.interval, vins, self.sentinel)
        return operators.downsample(series, r.column_name, r.aggregator, r.time_lower_bound, r.time_upper_bound, r.interval, r.column_filter, vins, self.sentinel)

    def execute_downsample_query(self, request: TimeRangeDownsampleRequest) -> DataFrame:
        return self.downsample(request, [request.vin])

    @staticmethod
    def rows(df: DataFrame) -> Sequence[Row]:
        """A result's rows on the driver; for results of single requests."""
        names = [c for c in df.columns if c not in ("vin", "ts")]
        return [Row(r["vin"], r["ts"], {n: r[n] for n in names}) for r in df.collect()]
