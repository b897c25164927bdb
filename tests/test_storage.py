"""Stored tables: buckets, order of writing, rollups and newest rows that appends keep, appends that are tried again, counters."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tests.test_engine import AVG, GOLD, MAX, T0, table
from tidemark import (
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
from tidemark import operators, plans
from tidemark.sources.adapters import Series
from tidemark.sources.storage import Table
from tidemark.streaming.ingest import ingest

ONE = Schema({"x": ColumnType.DOUBLE_FLOAT})


def frame(spark, rows):
    return spark.createDataFrame(rows, "vin string, ts long, x double")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reopened_with_other_buckets(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), buckets=16).connect()
    engine.create_table("t", ONE)
    engine.write_frame("t", frame(spark, [(f"v{n}", t, float(t)) for n in range(10) for t in range(5)]))
    for buckets in (1, 7, 64):
        again = Engine(spark, str(tmp_path), buckets=buckets).connect()
        assert again.execute_latest_query(LatestQueryRequest("t", [f"v{n}" for n in range(10)])).count() == 10
        assert all(again.execute_time_range_query(TimeRangeQueryRequest("t", f"v{n}", 0, 5)).count() == 5 for n in range(10))
        again.write_frame("t", frame(spark, [("more", buckets, 1.0)]))
    assert Engine(spark, str(tmp_path)).connect().execute_time_range_query(TimeRangeQueryRequest("t", "more", 0, 100)).count() == 3
    assert Table.of(json.dumps(json.loads(ONE.struct().json())), 5).buckets == 5  # a schema alone, from before buckets were kept
    with pytest.raises(ValueError):
        Engine(spark, str(tmp_path), buckets=0)


def test_first_written_wins_and_last_with_dedup(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), buckets=2).connect()
    engine.create_table("t", ONE)
    engine.write(WriteRequest("t", [Row("a", 5, {"x": 1.0}), Row("a", 5, {"x": 2.0}), Row("a", 4, {"x": 9.0})]))
    engine.write(WriteRequest("t", [Row("a", 5, {"x": 3.0}), Row("b", 1, {"x": 7.0})]))
    engine.write_frame("t", frame(spark, [("a", 5, 4.0), ("a", 5, 5.0)]).coalesce(1))
    last = Engine(spark, str(tmp_path), dedup="last").connect()
    ask = LatestQueryRequest("t", ["a", "b"])
    for _ in range(3):
        assert {r.vin: r.x for r in engine.execute_latest_query(ask).collect()} == {"a": 1.0, "b": 7.0}
        assert {r.vin: r.x for r in last.execute_latest_query(ask).collect()} == {"a": 5.0, "b": 7.0}
    # the small tables of newest rows say the same as all rows
    assert {r.vin: r.x for r in operators.latest(engine.series("t")).collect()} == {"a": 1.0, "b": 7.0}
    assert {r.vin: r.x for r in operators.latest(last.series("t")).collect()} == {"a": 5.0, "b": 7.0}
    rows = lambda e: sorted((r.ts, r.x) for r in e.execute_time_range_query(TimeRangeQueryRequest("t", "a", 0, 9)).collect())
    assert rows(engine) == [(4, 9.0), *[(5, float(n)) for n in range(1, 6)]] and rows(last) == [(4, 9.0), (5, 5.0)]
    asked = spark.createDataFrame([(1, "a", 0, 9), (2, "a", 5, 6), (2, "b", 0, 9)], "request_id int, vin string, lo long, hi long")
    got = operators.range_batch(last.series("t"), asked, ["x"])
    assert sorted((r.request_id, r.vin, r.x) for r in got.collect()) == [(1, "a", 5.0), (1, "a", 9.0), (2, "a", 5.0), (2, "b", 7.0)]


def test_dedup_reads_one_bucket_and_shuffles_once(spark, tmp_path):
    engine = table(spark, tmp_path, [1, 2, 3])
    last = Engine(spark, str(tmp_path), dedup="last").connect()
    plan = plan_of(last.execute_time_range_query(TimeRangeQueryRequest("t", "LSVNV2182E0200001", T0, T0 + 5000, ["temp"])))
    assert "PartitionFilters: [isnotnull(bucket" in plan and "GreaterThanOrEqual(ts" in plan and plan.count("Exchange") == 1
    assert "Exchange" not in plan_of(engine.execute_time_range_query(TimeRangeQueryRequest("t", "LSVNV2182E0200001", T0, T0 + 5000, ["temp"])))


def test_rollup_equals_rows_with_nulls_and_nan(spark):
    nan = math.nan
    rows = [("a", 1, 1.0), ("a", 2, None), ("b", 5, 1.0), ("b", 6, nan), ("b", 15, None), ("c", 3, None), ("d", 4, nan), ("d", 14, nan), ("e", -5, 2.0), ("e", 33, 8.0)]
    series = Series(frame(spark, rows), ONE)
    rollup = plans.build_rollup(series, ["x"], 10)
    text = lambda df: sorted((r.vin, r.ts, repr(r.x)) for r in df.collect())
    for aggregator in (AVG, MAX):
        for lo, hi in ((-20, 40), (0, 20), (3, 17), (-5, 34), (1, 3)):
            for sentinel in ("reference", "null"):
                got = plans.aggregate_with_rollup(series, rollup, "x", 10, aggregator, lo, hi, None, sentinel)
                assert text(got) == text(operators.aggregate(series, "x", aggregator, lo, hi, None, None, sentinel)), (aggregator, lo, hi)
                if lo % 20 == 0 and hi % 20 == 0:
                    got = plans.downsample_with_rollup(series, rollup, "x", 10, aggregator, lo, hi, 20, None, sentinel)
                    assert text(got) == text(operators.downsample(series, "x", aggregator, lo, hi, 20, None, None, sentinel))


def test_engine_answers_from_what_appends_keep(spark, tmp_path):
    """Several appends; the engine gives the same with and without stored aggregates, and reads raw rows only at the edges."""
    schema = Schema({"i": ColumnType.INTEGER, "d": ColumnType.DOUBLE_FLOAT, "s": ColumnType.STRING})
    engine = Engine(spark, str(tmp_path), buckets=4, block=100).connect()
    engine.create_table("w", schema)
    rows = spark.range(600).select((F.col("id") % 3).cast("string").alias("vin"), (F.col("id") * 7 % 1000).alias("ts"), F.col("id").cast("int").alias("i"), (F.col("id") * 0.25).alias("d"), F.lit("x").alias("s"))
    for n in range(3):
        engine.write_frame("w", rows.where(F.col("id") % 3 == n) if n else rows.where(F.col("id") % 3 == 0))
    raw = Engine(spark, str(tmp_path), stored_aggregates=False).connect()
    for column in ("i", "d"):
        for aggregator in (AVG, MAX):
            for lo, hi in ((0, 1000), (13, 987), (200, 300), (250, 260)):
                ask = TimeRangeAggregationRequest("w", "1", column, lo, hi, aggregator)
                a, b = engine.execute_aggregate_query(ask).collect(), raw.execute_aggregate_query(ask).collect()
                assert [tuple(r) for r in a] == [pytest.approx(tuple(r)) for r in b]
            for lo, interval, test in ((0, 200, None), (50, 100, None), (0, 500, CompareExpression(10, CompareOp.GREATER))):
                ask = TimeRangeDownsampleRequest("w", "2", column, lo, lo + 1000, aggregator, interval, test)
                a, b = engine.execute_downsample_query(ask).collect(), raw.execute_downsample_query(ask).collect()
                assert sorted(map(tuple, a)) == [pytest.approx(tuple(r)) for r in sorted(b)]
    whole = engine.execute_aggregate_query(TimeRangeAggregationRequest("w", "1", "d", 0, 1000, MAX)).inputFiles()
    assert whole and all("/w.rollup/" in f for f in whole)
    newest = engine.execute_latest_query(LatestQueryRequest("w", ["1"])).inputFiles()
    assert newest and all("/w.latest/" in f for f in newest)
    with pytest.raises(TypeError):
        engine.execute_aggregate_query(TimeRangeAggregationRequest("w", "1", "s", 0, 10, MAX))


def test_appends_of_a_mark_are_made_once_and_halves_are_not_seen(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), buckets=2, block=10).connect()
    engine.create_table("t", ONE)
    for _ in range(3):
        engine.write_frame("t", frame(spark, [("a", 1, 2.0), ("a", 25, 4.0)]), mark="batch_7")
    assert engine.series("t").df.count() == 2 and engine.stats["t"] == {"appends": 1, "rows": 2, "from": 1, "to": 25}
    engine.write_frame("t", frame(spark, []))
    engine.write_frame("t", frame(spark, [("a", 30, 6.0)]))
    assert engine.stats["t"] == {"appends": 2, "rows": 3, "from": 1, "to": 30}
    # an append that ended before its rows' folder was renamed: what it left beside isn't read
    frame(spark, [("a", 99, 50.0)]).selectExpr("vin", "ts", "x", "1L AS written", "0L AS nth").write.parquet(f"{tmp_path}/t.latest/append=lost")
    assert engine.execute_latest_query(LatestQueryRequest("t", ["a"])).first().ts == 30
    assert engine.execute_aggregate_query(TimeRangeAggregationRequest("t", "a", "x", 0, 100, AVG)).first().x == 4.0
    with pytest.raises(ValueError):
        engine.write_frame("t", frame(spark, [("a", 1, 1.0)]), mark="a/b")


def test_replayed_batches_are_appended_once(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "db") if (tmp_path / "db").mkdir() is None else "", buckets=2).connect()
    engine.create_table("t", ONE)
    (tmp_path / "in").mkdir()
    frame(spark, [("a", n, float(n)) for n in range(10)]).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("vin string, ts long, x double").json(str(tmp_path / "in"))
    ingest(engine, "t", stream(), str(tmp_path / "ck")).awaitTermination()
    assert engine.series("t").df.count() == 10
    (commit,) = [f for f in (tmp_path / "ck" / "commits").iterdir() if f.name == "0"]
    commit.unlink()  # as if the job had ended after the batch was written and before this was noted
    for crc in (tmp_path / "ck" / "commits").glob(".0.crc"):
        crc.unlink()
    ingest(engine, "t", stream(), str(tmp_path / "ck")).awaitTermination()
    assert engine.series("t").df.count() == 10
    frame(spark, [("a", 50, 1.0)]).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    ingest(engine, "t", stream(), str(tmp_path / "ck")).awaitTermination()
    assert engine.series("t").df.count() == 11


def test_all_buckets_of_a_grid(spark, monkeypatch):
    import importlib

    module = importlib.import_module("tidemark.operators.downsample")
    series = Series(frame(spark, [("a", 5, 1.0), ("b", 95, 2.0), ("c", 200, 3.0)]), ONE)
    for grid in (4096, 3, 1):
        monkeypatch.setattr(module, "GRID", grid)
        got = operators.downsample(series, "x", MAX, 0, 100, 10, emit_empty_buckets=True)
        want = [(v, t, 1.0 if (v, t) == ("a", 0) else 2.0 if (v, t) == ("b", 90) else -math.inf) for v in "ab" for t in range(0, 100, 10)]
        assert sorted(map(tuple, got.collect())) == want


def test_doubles_and_their_encoding(spark, tmp_path):
    """What the writer makes of doubles: dictionary or plain, then zstd."""
    import pyarrow.parquet as pq

    engine = Engine(spark, str(tmp_path), buckets=1).connect()
    engine.create_table("t", ONE)
    engine.write_frame("t", spark.range(50_000).select(F.lit("a").alias("vin"), F.col("id").alias("ts"), F.rand(3).alias("x")).coalesce(1))
    (file,) = [f.removeprefix("file://") for f in engine.series("t").df.inputFiles()]
    group = pq.ParquetFile(file).metadata.row_group(0)
    column = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}["x"]
    assert column.compression == "ZSTD" and set(column.encodings) & {"PLAIN", "BYTE_STREAM_SPLIT", "RLE_DICTIONARY"}
    assert GOLD.columns["temp"] is ColumnType.DOUBLE_FLOAT
