"""Series over any table: a key, a time axis and value columns, kept raw as long as predicates may be pushed down."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.time import millis, moment
from ..types import ColumnType, Schema


@dataclass(frozen=True)
class Series:
    """A table seen as series.

    ``key`` names the raw key column, ``vin`` makes the series key of it and ``raw_key`` the raw key of a series
    key (None if there is none). ``time`` names the raw time column, ``stored`` is "ms" or "ntz". ``values`` are
    the value columns by name. ``tie`` orders rows of one series and time, first to last; with ``dedup`` only the last of them
    counts. ``bucket`` gives the storage bucket of a series key, where the table is partitioned by one.
    """

    df: DataFrame
    schema: Schema
    key: str = "vin"
    time: str = "ts"
    stored: str = "ms"
    values: dict[str, Column] = field(default_factory=dict)
    vin: Callable[[Column], Column] = lambda c: c
    raw_key: Callable[[str], object | None] = lambda v: v
    tie: Sequence[str] = ()
    bucket: Callable[[Column], Column] | None = None
    dedup: bool = False

    def value(self, name: str) -> Column:
        return self.values.get(name, F.col(name)).cast(self.schema.columns[name].spark)

    def only(self, vins: Sequence[str] | None) -> DataFrame:
        """The rows of these series, None for all. Few keys become an IN list, many a semi join."""
        if vins is None:
            return self.df
        raw = [k for k in (self.raw_key(v) for v in dict.fromkeys(vins)) if k is not None]
        df = self.df
        if len(raw) <= 1000:
            if self.bucket is not None and 0 < len(raw) <= 16:  # folded to literals, so that other buckets' folders aren't listed
                df = df.where(reduce(or_, (F.col("bucket") == self.bucket(F.lit(k)) for k in raw)))
            return df.where(F.col(self.key).isin(raw))
        asked = df.sparkSession.createDataFrame([(k,) for k in raw], ["asked"])
        return df.join(asked, F.col(self.key) == F.col("asked"), "left_semi")

    def within(self, df: DataFrame, lo: int, hi: int) -> DataFrame:
        """Rows of the half-open range, on the raw column."""
        return df.where((F.col(self.time) >= moment(lo, self.stored)) & (F.col(self.time) < moment(hi, self.stored)))

    def frame(self, df: DataFrame, columns: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
        """vin, ts and the columns asked for; where only the last row of a time counts, of what filters have left."""
        if self.dedup:
            df = last_of(df, [self.key, self.time], self.tie)
        return df.select(self.vin(F.col(self.key)).alias("vin"), millis(F.col(self.time), self.stored).alias("ts"), *[self.value(c).alias(c) for c in columns], *extra)


def last_of(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*map(F.desc, order)))).where("place = 1").drop("place")


def _padded(c: Column) -> Column:
    return F.lpad(c.cast("string"), 17, "0")


def _number(vin: str) -> int | None:
    return int(vin) if len(vin) == 17 and vin.isascii() and vin.isdigit() else None


def events(spark: SparkSession, sf_dir: str) -> Series:
    """Events by user: value (double), k (integer) and event_type (string)."""
    k = F.get_json_object("props", "$.k").cast("int")
    return Series(spark.read.parquet(f"{sf_dir}/events.parquet"), Schema({"value": ColumnType.DOUBLE_FLOAT, "k": ColumnType.INTEGER, "event_type": ColumnType.STRING}), "user_id", "ts", "ntz", {"k": k}, _padded, _number, ("event_id",))


def lineitems(spark: SparkSession, sf_dir: str) -> Series:
    """Line items by supplier: real integers, and many rows of one series and time."""
    kinds = {"l_linenumber": ColumnType.INTEGER, "l_quantity": ColumnType.DOUBLE_FLOAT, "l_extendedprice": ColumnType.DOUBLE_FLOAT, "l_returnflag": ColumnType.STRING}
    return Series(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), Schema(kinds), "l_suppkey", "l_shipdate", "ntz", {}, _padded, _number, ("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice"))


def orders(spark: SparkSession, sf_dir: str) -> Series:
    """Orders by customer."""
    return Series(spark.read.parquet(f"{sf_dir}/orders.parquet"), Schema({"o_totalprice": ColumnType.DOUBLE_FLOAT, "o_orderstatus": ColumnType.STRING}), "o_custkey", "o_orderdate", "ntz", {}, _padded, _number, ("o_orderkey",))
