"""Stored tables: Parquet partitioned by a bucket of the series key, with the schema as JSON beside.

A table's number of buckets and its rollup's block are kept with the schema, whatever the engine that opens it is set to.
Every append has a folder of its own for its rows, and beside the rows two small tables that it makes of them: a rollup of all
numeric columns by block of time, and the newest row of each series. Readers take the appends whose rows are there, so that an
append appears at once, by the renaming of its rows' folder, or not at all.

Everything goes through Spark's file systems. The renaming must be atomic, as it is in HDFS and on local disks.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import VIN_BYTES, ColumnType, Row, Schema, check_vin
from .adapters import Series

BUCKETS, BLOCK = 64, 3_600_000
#: Writer options: version 2 pages store times and integers without a dictionary as bit-packed differences.
CODECS = {"compression": "zstd", "parquet.writer.version": "v2"}
#: When an append was written, in nanoseconds, and a row's place in it: the order of writing.
WRITTEN = (T.StructField("written", T.LongType(), False), T.StructField("nth", T.LongType(), False))
ORDER = ("written", "append", "nth")
_NAME = re.compile(r"[A-Za-z0-9_]+")


def bucket_of(buckets: int):
    return lambda vin: F.pmod(F.xxhash64(vin), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Table:
    """What is kept of a table: its schema, number of buckets and milliseconds of a rollup's block."""

    schema: Schema
    buckets: int = BUCKETS
    block: int = BLOCK

    def numeric(self) -> list[str]:
        return [c for c, kind in self.schema.columns.items() if kind is not ColumnType.STRING]

    def json(self) -> str:
        return json.dumps({"schema": self.schema.struct().jsonValue(), "buckets": self.buckets, "block": self.block})

    @classmethod
    def of(cls, text: str, buckets: int) -> Table:
        """Of its JSON; a schema alone is from before the other two were kept."""
        kept = json.loads(text)
        if "schema" not in kept:
            kept = {"schema": kept, "buckets": buckets, "block": BLOCK}
        return cls(Schema.of(T.StructType.fromJson(kept["schema"])), kept["buckets"], kept["block"])


class Store:
    """The tables of a base folder, which must be there. ``buckets`` and ``block`` are those of tables made from now on."""

    def __init__(self, spark: SparkSession, base: str, buckets: int = BUCKETS, block: int = BLOCK):
        if buckets < 1 or block < 1:
            raise ValueError("buckets and block are positive")
        self.spark, self.base, self.buckets, self.block = spark, base.rstrip("/"), buckets, block
        path = self._path("")
        if not (self._fs(path).exists(path) and self._fs(path).getFileStatus(path).isDirectory()):
            raise FileNotFoundError(f"no folder {base}")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def _fs(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        path = self._path(name)
        return sorted(f.getPath().getName() for f in self._fs(path).listStatus(path)) if self._fs(path).exists(path) else []

    def _read_text(self, name: str) -> str:
        path = self._path(name)
        stream = self._fs(path).open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write_text(self, name: str, text: str) -> None:
        """Written beside and then renamed, so that a reader never meets half of it."""
        path, new = self._path(name), self._path(name + ".new")
        stream = self._fs(new).create(new, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self._fs(path).exists(path):
            self._fs(path).delete(path, False)
        if not self._fs(new).rename(new, path):
            raise OSError(f"{path} can't be written")

    def tables(self) -> dict[str, Table]:
        """All tables there."""
        return {n.removesuffix(".json"): Table.of(self._read_text(f"_schemas/{n}"), self.buckets) for n in self._names("_schemas") if n.endswith(".json")}

    def create(self, name: str, schema: Schema) -> Table:
        if not _NAME.fullmatch(name):
            raise ValueError(f"a table name is letters, digits and underscores, not {name!r}")
        if name in self.tables():
            raise ValueError(f"table {name} is there already")
        made = Table(schema, self.buckets, self.block)
        self._write_text(f"_schemas/{name}.json", made.json())
        return made

    def folder(self, name: str, part: str = "") -> str:
        return f"{self.base}/{name}{part and '.'}{part}"

    def appends(self, name: str) -> list[str]:
        """The appends of a table that are whole; each call lists them anew."""
        return [n for n in self._names(name) if n.startswith("append=")]

    def _read(self, name: str, part: str, struct: T.StructType) -> DataFrame:
        paths = [f"{self.folder(name, part)}/{a}" for a in self.appends(name)]
        if not paths:
            return self.spark.createDataFrame([], struct)
        return self.spark.read.schema(struct).option("basePath", self.folder(name, part)).parquet(*paths)

    def series(self, name: str, table: Table, dedup: str | None = None) -> Series:
        """A table as it stands."""
        struct = T.StructType([*table.schema.struct().fields, *WRITTEN, T.StructField("append", T.StringType()), T.StructField("bucket", T.IntegerType())])
        return Series(self._read(name, "", struct), table.schema, bucket=bucket_of(table.buckets), tie=ORDER, dedup=dedup == "last")

    def newest(self, name: str, table: Table, dedup: str | None = None) -> Series:
        """The newest rows of each append: all that a query of the newest rows needs."""
        struct = T.StructType([*table.schema.struct().fields, *WRITTEN, T.StructField("append", T.StringType())])
        return Series(self._read(name, "latest", struct), table.schema, tie=ORDER, dedup=dedup == "last")

    def rollup(self, name: str, table: Table) -> DataFrame:
        """The rollups of all appends: several rows of a series and block."""
        fields = [T.StructField("vin", T.StringType()), T.StructField("block_start", T.LongType())]
        for c in table.numeric():
            fields += [T.StructField(f"n_{c}", T.LongType()), T.StructField(f"total_{c}", T.DoubleType()), T.StructField(f"most_{c}", table.schema.columns[c].spark)]
        return self._read(name, "rollup", T.StructType([*fields, T.StructField("append", T.StringType())])).drop("append")

    def rows_frame(self, rows: Sequence[Row], schema: Schema) -> DataFrame:
        """Rows as a DataFrame in the order given; each must hold every column, of its type, and none null."""
        made = []
        for n, row in enumerate(rows):
            check_vin(row.vin)
            if not isinstance(row.timestamp, int) or isinstance(row.timestamp, bool):
                raise TypeError(f"a timestamp is an integer of milliseconds, not {row.timestamp!r}")
            if set(row.columns) != set(schema.columns):
                raise ValueError(f"a row needs just the columns {', '.join(schema.columns)}")
            for name, kind in schema.columns.items():
                kind.check(row.columns[name], f"column {name}")
            made.append((row.vin, row.timestamp, *[float(row.columns[c]) if k.spark == T.DoubleType() else row.columns[c] for c, k in schema.columns.items()], time.time_ns(), n))
        return self.spark.createDataFrame(made, T.StructType([*schema.struct().fields, *WRITTEN]))

    def checked_frame(self, df: DataFrame, schema: Schema) -> DataFrame:
        """The columns of a frame in the schema's types, in scan order; a null or an overlong key fails the write."""
        missing = [c for c in schema.struct().names if c not in df.columns]
        if missing:
            raise ValueError(f"columns are missing: {', '.join(missing)}")
        for f in schema.struct().fields:
            if df.schema[f.name].dataType != f.dataType:
                raise TypeError(f"column {f.name} is {df.schema[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")

        def whole(f: T.StructField) -> Column:
            good = F.col(f.name).isNotNull()
            if f.name == "vin":
                good &= F.octet_length(F.col(f.name)).between(1, VIN_BYTES)
            return F.when(good, F.col(f.name)).otherwise(F.raise_error(F.lit(f"column {f.name} holds a null or an overlong key")).cast(f.dataType)).alias(f.name)

        return df.select(*[whole(f) for f in schema.struct().fields], F.lit(time.time_ns()).cast("long").alias("written"), F.monotonically_increasing_id().alias("nth"))

    def append(self, name: str, table: Table, df: DataFrame, mark: str | None = None) -> dict | None:
        """Append by bucket, in a folder of its own that appears at once when all is written, so that appends may run side by side.

        An append of a given ``mark`` that is there already is left alone (None), so that it may be tried again. A crowded
        bucket, even of one series, is split among tasks by the rebalance; files are in key and time order. Returns the number of rows and their times' bounds.
        """
        from ..plans.rollup import build_rollup

        mark = mark or uuid.uuid4().hex
        if not _NAME.fullmatch(mark):
            raise ValueError(f"an append's mark is letters, digits and underscores, not {mark!r}")
        hidden, shown = self._path(f"{name}/_new-{uuid.uuid4().hex}"), self._path(f"{name}/append={mark}")
        if self._fs(shown).exists(shown):
            return None
        dealt = df.withColumn("bucket", bucket_of(table.buckets)(F.col("vin"))).hint("rebalance", "bucket")
        dealt.sortWithinPartitions("bucket", "vin", "ts").write.partitionBy("bucket").options(**CODECS).parquet(hidden.toString())
        stored = self.spark.read.schema(T.StructType([*table.schema.struct().fields, *WRITTEN])).parquet(hidden.toString())
        counted = stored.agg(F.count("*").alias("rows"), F.min("ts").alias("from"), F.max("ts").alias("to")).first().asDict()
        if counted["rows"]:
            rows = F.struct("vin", "ts", *table.schema.columns, "written", "nth")
            ends = stored.groupBy("vin").agg(F.max_by(rows, F.struct("ts", -F.col("nth"))).alias("a"), F.max_by(rows, F.struct("ts", "nth")).alias("b"))  # of the newest time, the first written and the last
            newest = ends.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("r")).select("r.*")
            newest.sortWithinPartitions("vin").write.mode("overwrite").options(**CODECS).parquet(f"{self.folder(name, 'latest')}/append={mark}")
            blocks = build_rollup(Series(stored, table.schema), table.numeric(), table.block) if table.numeric() else stored.select("vin", F.lit(0).cast("long").alias("block_start")).limit(0)
            blocks.sortWithinPartitions("vin", "block_start").write.mode("overwrite").options(**CODECS).parquet(f"{self.folder(name, 'rollup')}/append={mark}")
            if not self._fs(shown).rename(hidden, shown):
                raise OSError(f"{shown} can't be made")
        else:
            self._fs(hidden).delete(hidden, True)
        return counted
