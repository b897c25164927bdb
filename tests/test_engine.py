"""The interface's examples, decisions on its open points, and write - reopen - read."""

import struct

import pytest
from pyspark.sql import functions as F

from tidemark import (
    Aggregator,
    ColumnType,
    CompareExpression,
    CompareOp,
    Engine,
    LatestQueryRequest,
    Row,
    Schema,
    TimeRangeAggregationRequest,
    TimeRangeDownsampleRequest,
    TimeRangeQueryRequest,
    WriteRequest,
)
from tidemark.types import NO_DOUBLE, NO_INTEGER

AVG, MAX, EQ, GT = Aggregator.AVG, Aggregator.MAX, CompareOp.EQUAL, CompareOp.GREATER
T0 = 1693274400000
GOLD = Schema({"AZKP": ColumnType.INTEGER, "temp": ColumnType.DOUBLE_FLOAT, "note": ColumnType.STRING})


def table(spark, path, values, name="t"):
    engine = Engine(spark, str(path), buckets=4).connect()
    engine.create_table(name, GOLD)
    engine.write(WriteRequest(name, [Row("LSVNV2182E0200001", T0 + 1000 * i, {"AZKP": v, "temp": float(v), "note": "" if i else "a,\"b\"\n"}) for i, v in enumerate(values)]))
    return engine


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    return table(spark, tmp_path_factory.mktemp("gold"), [15, 11, 13, 15, 17, 19, 21, 20, 18, 16])


def downsample(engine, lo, hi, interval, test=None, column="temp", aggregator=AVG):
    got = engine.execute_downsample_query(TimeRangeDownsampleRequest("t", "LSVNV2182E0200001", column, lo, hi, aggregator, interval, test))
    return sorted((r["ts"], r[column]) for r in got.collect())


def test_sentinel_bits():
    assert struct.pack(">d", NO_DOUBLE).hex() == "fff0000000000000" and NO_INTEGER == -0x80000000


def test_aggregate_example(spark, tmp_path):
    engine = table(spark, tmp_path, [10, 11, 13, 15, 17, 19, 21, 20, 18, 16])
    ask = lambda column, aggregator, lo=T0 + 155, hi=T0 + 10235: [tuple(r) for r in engine.execute_aggregate_query(TimeRangeAggregationRequest("t", "LSVNV2182E0200001", column, lo, hi, aggregator)).collect()]
    assert ask("AZKP", MAX) == [("LSVNV2182E0200001", T0 + 155, 21)]
    assert ask("AZKP", AVG)[0][2] == pytest.approx(150 / 9) and isinstance(ask("AZKP", MAX)[0][2], int)
    assert ask("temp", MAX, 0, 5) == []
    with pytest.raises(TypeError):
        ask("note", MAX)
    with pytest.raises(KeyError):
        ask("none", MAX)


def test_downsample_examples(engine):
    lo, hi = T0 + 183, T0 + 10183
    for column in ("temp", "AZKP"):
        assert downsample(engine, lo, hi, 5000, CompareExpression(11, GT), column) == [(lo, 16.0), (lo + 5000, 18.75)]
        assert downsample(engine, lo, hi, 5000, CompareExpression(20, EQ), column) == [(lo, NO_DOUBLE), (lo + 5000, 20.0)]
    assert downsample(engine, lo, hi, 5000, CompareExpression(20, GT), "AZKP", MAX) == [(lo, NO_INTEGER), (lo + 5000, 21)]
    assert downsample(engine, T0 + 10000, T0 + 20000, 5000, CompareExpression(10, GT)) == []
    assert downsample(engine, T0, T0 + 20000, 5000) == [(T0, 14.2), (T0 + 5000, 18.8)]  # buckets without rows are left out


def test_downsample_rejects(engine):
    with pytest.raises(ValueError):
        downsample(engine, T0, T0 + 10000, 3000)
    with pytest.raises(ValueError):
        downsample(engine, T0, T0, 1)
    with pytest.raises(TypeError):
        downsample(engine, T0, T0 + 10000, 5000, CompareExpression("20", EQ))
    with pytest.raises(TypeError):
        downsample(engine, T0, T0 + 10000, 5000, CompareExpression(20.5, EQ), "AZKP")


def test_range_bounds_and_projection(engine):
    got = engine.execute_time_range_query(TimeRangeQueryRequest("t", "LSVNV2182E0200001", T0 + 1000, T0 + 3000, ["AZKP"]))
    assert got.columns == ["vin", "ts", "AZKP"] and sorted((r.ts, r.AZKP) for r in got.collect()) == [(T0 + 1000, 11), (T0 + 2000, 13)]
    assert engine.execute_time_range_query(TimeRangeQueryRequest("t", "unknown", 0, 1)).collect() == []
    everything = engine.execute_time_range_query(TimeRangeQueryRequest("t", "LSVNV2182E0200001", T0, T0 + 1))
    assert everything.columns == ["vin", "ts", "AZKP", "note", "temp"]
    assert engine.rows(everything) == [Row("LSVNV2182E0200001", T0, {"AZKP": 15, "note": "a,\"b\"\n", "temp": 15.0})]
    with pytest.raises(KeyError):
        engine.execute_time_range_query(TimeRangeQueryRequest("t", "unknown", 0, 1, ["nope"]))


def test_latest(engine):
    got = engine.execute_latest_query(LatestQueryRequest("t", ["LSVNV2182E0200001", "LSVNV2182E0200001", "missing"], ["temp"])).collect()
    assert [tuple(r) for r in got] == [("LSVNV2182E0200001", T0 + 9000, 16.0)]
    assert engine.execute_latest_query(LatestQueryRequest("t", [])).collect() == []


def test_two_series_with_overwrite_and_restart(spark, tmp_path):
    schema = Schema({"t1c1": ColumnType.INTEGER, "t1c2": ColumnType.DOUBLE_FLOAT, "t1c3": ColumnType.STRING})
    row = lambda vin, ts, v: Row(vin, ts, {"t1c1": v, "t1c2": v + 0.1, "t1c3": f"s{v}\x00\n"})
    engine = Engine(spark, str(tmp_path), buckets=3, dedup="last").connect()
    engine.create_table("t1", schema)
    engine.create_table("t2", schema)
    engine.write(WriteRequest("t1", [row("vin1", 1, 100)]))
    engine.write(WriteRequest("t1", [row("vin2", 3, 101), row("vin1", 2, 102), row("vin1", 1, 200)]))
    engine.write(WriteRequest("t2", [row("vin1", 9, 7)]))

    def check(engine):
        latest = {r.vin: (r.ts, r.t1c1) for r in engine.execute_latest_query(LatestQueryRequest("t1", ["vin1", "vin1", "vin2"])).collect()}
        assert latest == {"vin1": (2, 102), "vin2": (3, 101)}
        first = engine.execute_time_range_query(TimeRangeQueryRequest("t1", "vin1", 1, 2)).collect()
        assert [(r.ts, r.t1c1, r.t1c3) for r in first] == [(1, 200, "s200\x00\n")]
        assert engine.execute_time_range_query(TimeRangeQueryRequest("t1", "vin1", 1, 6)).count() == 2
        assert engine.execute_time_range_query(TimeRangeQueryRequest("t2", "vin1", 1, 60)).count() == 1

    check(engine)
    engine.shutdown()
    with pytest.raises(RuntimeError):
        engine.execute_latest_query(LatestQueryRequest("t1", ["vin1"]))
    again = Engine(spark, str(tmp_path), buckets=3, dedup="last").connect()
    assert again.schemas["t1"] == schema
    check(again)
    again.write(WriteRequest("t1", [row("vin2", 4, 9)]))  # writing goes on after a restart, readable at once
    assert again.execute_latest_query(LatestQueryRequest("t1", ["vin2"])).first().t1c1 == 9
    keep_all = Engine(spark, str(tmp_path), buckets=3).connect()
    assert keep_all.execute_time_range_query(TimeRangeQueryRequest("t1", "vin1", 1, 2)).count() == 2


def test_one_series_reads_one_bucket(engine):
    got = engine.execute_time_range_query(TimeRangeQueryRequest("t", "LSVNV2182E0200001", T0, T0 + 5000, ["temp"]))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "pmod" not in plan and "Exchange" not in plan and got.count() == 5


def test_writes_are_checked(spark, tmp_path):
    engine = table(spark, tmp_path, [1])
    good = {"AZKP": 1, "temp": 1.0, "note": ""}
    for bad in ({"AZKP": 1}, good | {"AZKP": None}, good | {"AZKP": 2**31}, good | {"temp": "x"}, good | {"more": 1}):
        with pytest.raises((ValueError, TypeError)):
            engine.write(WriteRequest("t", [Row("v", 1, bad)]))
    with pytest.raises(ValueError):
        engine.write(WriteRequest("t", [Row("x" * 18, 1, good)]))
    with pytest.raises(KeyError):
        engine.write(WriteRequest("none", [Row("v", 1, good)]))
    with pytest.raises(ValueError):
        engine.create_table("t", GOLD)
    with pytest.raises(FileNotFoundError):
        Engine(spark, str(tmp_path / "none"))
    frame = spark.createDataFrame([("v", 1, 1, "", None)], "vin string, ts long, AZKP int, note string, temp double")
    with pytest.raises(Exception, match="null"):
        engine.write_frame("t", frame)
    engine.write_frame("t", frame.withColumn("temp", F.lit(float("nan"))))
    assert engine.execute_latest_query(LatestQueryRequest("t", ["v"])).count() == 1


def test_nan_is_passed_over(spark, tmp_path):
    engine = table(spark, tmp_path, [1])
    frame = spark.createDataFrame([("v", t, 1, "", x) for t, x in enumerate([float("nan"), 3.0, 2.0])], "vin string, ts long, AZKP int, note string, temp double")
    engine.write_frame("t", frame)
    assert engine.execute_aggregate_query(TimeRangeAggregationRequest("t", "v", "temp", 0, 9, MAX)).first().temp == 3.0
    got = engine.execute_downsample_query(TimeRangeDownsampleRequest("t", "v", "temp", 0, 9, AVG, 9, CompareExpression(2.5, GT)))
    assert got.first().temp == 3.0


def test_closed_form_series(spark, tmp_path):
    """Values that are their row's number, many series, written shuffled."""
    schema = Schema({"i": ColumnType.INTEGER, "d": ColumnType.DOUBLE_FLOAT, "s": ColumnType.STRING})
    engine = Engine(spark, str(tmp_path), buckets=8).connect()
    engine.create_table("wide", schema)
    r = F.col("id") % 60
    frame = spark.range(8 * 60).select((F.col("id") / 60).cast("int").cast("string").alias("vin"), (r * 1000).alias("ts"), r.cast("int").alias("i"), r.cast("double").alias("d"), F.repeat(F.char(97 + r % 26), F.lit(30)).alias("s"))
    engine.write_frame("wide", frame.orderBy(F.rand(1)))
    assert {x.i for x in engine.execute_latest_query(LatestQueryRequest("wide", [str(v) for v in range(8)])).collect()} == {59}
    for start, n in ((0, 60), (7, 10), (59, 5)):
        n_rows = min(n, 60 - start)
        lo, hi = start * 1000, (start + n) * 1000
        assert engine.execute_time_range_query(TimeRangeQueryRequest("wide", "3", lo, hi)).count() == n_rows
        assert engine.execute_aggregate_query(TimeRangeAggregationRequest("wide", "3", "i", lo, hi, MAX)).first().i == start + n_rows - 1
        assert engine.execute_aggregate_query(TimeRangeAggregationRequest("wide", "3", "d", lo, hi, AVG)).first().d == (2 * start + n_rows - 1) / 2
    got = engine.execute_downsample_query(TimeRangeDownsampleRequest("wide", "5", "i", 0, 60_000, MAX, 10_000, CompareExpression(4, GT)))
    assert sorted((x.ts, x.i) for x in got.collect()) == [(j * 10_000, j * 10 + 9) for j in range(6)]


def test_requests_from_several_threads(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    engine = table(spark, tmp_path, [1])

    def work(n):
        vin = f"v{n}"
        engine.write(WriteRequest("t", [Row(vin, i, {"AZKP": n * 10 + i, "temp": 0.5, "note": vin}) for i in range(10)]))
        got = engine.execute_aggregate_query(TimeRangeAggregationRequest("t", vin, "AZKP", 0, 10, MAX)).first().AZKP  # readable at once
        return got == n * 10 + 9 and engine.execute_latest_query(LatestQueryRequest("t", [vin])).first().ts == 9

    with ThreadPoolExecutor(4) as pool:
        assert all(pool.map(work, range(6)))
    assert engine.series("t").df.count() == 61


def test_times_are_stored_as_differences(engine):
    import pyarrow.parquet as pq

    (file,) = [f.removeprefix("file://") for f in engine.series("t").df.inputFiles()]
    group = pq.ParquetFile(file).metadata.row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["ts"].encodings and columns["ts"].compression == "ZSTD" and columns["ts"].statistics.min == T0
