"""Operators over frames: properties against plain Python, rollups, batches, plans and streams."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark import Aggregator, ColumnType, CompareExpression, CompareOp, Engine, Schema, operators, plans
from tidemark.sources import Series, adapters
from tidemark.streaming import downsample_stream, ingest

AVG, MAX, EQ, GT = Aggregator.AVG, Aggregator.MAX, CompareOp.EQUAL, CompareOp.GREATER
SCHEMA = Schema({"i": ColumnType.INTEGER, "d": ColumnType.DOUBLE_FLOAT})


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    return [(f"v{rng.randrange(5)}", rng.randrange(-500, 2000), rng.randrange(-9, 10), rng.randrange(-9, 10) / 4) for _ in range(600)]


@pytest.fixture(scope="module")
def series(spark, rows):
    return Series(spark.createDataFrame(rows, "vin string, ts long, i int, d double").cache(), SCHEMA)


def plain(rows, column, aggregator, lo, hi, interval, test):
    at, groups = 2 if column == "i" else 3, {}
    for r in rows:
        if lo <= r[1] < hi:
            groups.setdefault((r[0], lo + (r[1] - lo) // interval * interval), []).append(r[at])
    out = {}
    for k, values in groups.items():
        kept = [v for v in values if test is None or (v == test.value if test.op is EQ else v > test.value)]
        none = -(2**31) if column == "i" and aggregator is MAX else float("-inf")
        out[k] = none if not kept else max(kept) if aggregator is MAX else sum(kept) / len(kept)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_random_requests(series, rows, seed):
    rng = random.Random(seed)
    column, aggregator = rng.choice(["i", "d"]), rng.choice([AVG, MAX])
    test = rng.choice([None, CompareExpression(rng.randrange(-9, 10), rng.choice([EQ, GT]))])
    interval, lo = rng.choice([7, 100, 333]), rng.randrange(-600, 500)
    hi = lo + interval * rng.randrange(1, 9)
    got = {(r.vin, r.ts): r[column] for r in operators.downsample(series, column, aggregator, lo, hi, interval, test).collect()}
    assert got == pytest.approx(plain(rows, column, aggregator, lo, hi, interval, test))
    whole = {(r.vin, r.ts): r[column] for r in operators.aggregate(series, column, aggregator, lo, hi, None, test).collect()}
    assert whole == pytest.approx(plain(rows, column, aggregator, lo, hi, hi - lo, test))


def test_empty_buckets_on_request(series):
    got = operators.downsample(series, "i", MAX, 0, 20_000, 1000, emit_empty_buckets=True, vins=["v1"]).collect()
    assert sorted(r.ts for r in got) == list(range(0, 20_000, 1000)) and sum(r.i == -(2**31) for r in got) == 18


def test_null_sentinel(series):
    assert {r.d for r in operators.aggregate(series, "d", MAX, -600, 3000, None, CompareExpression(1e9, GT), "null").collect()} == {None}


def test_many_keys_become_a_join(series):
    some = operators.time_range(series, -600, 3000, [f"v{i}" for i in range(2, 2000)])
    assert "LeftSemi" in some._jdf.queryExecution().toString() and {r.vin for r in some.select("vin").distinct().collect()} == {"v2", "v3", "v4"}


def test_rollup_equals_rows(series):
    for column in ("i", "d"):
        rollup = plans.build_rollup(series, [column], 100).cache()
        for aggregator in (AVG, MAX):
            for lo, hi in ((-333, 1777), (-300, 1700), (10, 60), (5, 105)):
                want = {r.vin: r[column] for r in operators.aggregate(series, column, aggregator, lo, hi).collect()}
                got = plans.aggregate_with_rollup(series, rollup, column, 100, aggregator, lo, hi)
                assert got.schema == operators.aggregate(series, column, aggregator, lo, hi).schema or got.dtypes == operators.aggregate(series, column, aggregator, lo, hi).dtypes
                assert {r.vin: r[column] for r in got.collect()} == pytest.approx(want)
            want = {(r.vin, r.ts): r[column] for r in operators.downsample(series, column, aggregator, -300, 1700, 500).collect()}
            assert {(r.vin, r.ts): r[column] for r in plans.downsample_with_rollup(series, rollup, column, 100, aggregator, -300, 1700, 500).collect()} == pytest.approx(want)
    with pytest.raises(ValueError):
        plans.downsample_with_rollup(series, rollup, "d", 100, AVG, -333, 667, 500)


def test_batch_equals_single_requests(spark, series):
    asked = [("a", "v1", 0, 900, 300), ("b", "v1", -100, 500, 200), ("c", "none", 0, 900, 300)]
    requests = spark.createDataFrame(asked, "request_id string, vin string, lo long, hi long, interval long")
    down = operators.downsample_batch(series, requests, "d", AVG, CompareExpression(0.0, GT)).collect()
    whole = operators.aggregate_batch(series, requests, "i", MAX).collect()
    found = operators.range_batch(series, requests, ["i"]).collect()
    for name, vin, lo, hi, interval in asked:
        assert {r.ts: r.d for r in down if r.request_id == name} == {r.ts: r.d for r in operators.downsample(series, "d", AVG, lo, hi, interval, CompareExpression(0.0, GT), [vin]).collect()}
        assert {r.ts: r.i for r in whole if r.request_id == name} == {r.ts: r.i for r in operators.aggregate(series, "i", MAX, lo, hi, [vin]).collect()}
        assert sum(r.request_id == name for r in found) == operators.time_range(series, lo, hi, [vin]).count()


def test_snapshot_merges_in_any_order(spark, series, rows):
    want = {r.vin: r.ts for r in operators.latest(series).collect()}
    snapshot = None
    for at in range(0, 600, 200):
        part = Series(spark.createDataFrame(rows[at : at + 200], "vin string, ts long, i int, d double"), SCHEMA)
        snapshot = plans.merge_latest(snapshot, part)
    assert {r.vin: r.ts for r in snapshot.collect()} == want


def test_scans_push_filters_and_prune_columns(spark, tiny):
    plan = operators.time_range(adapters.events(spark, tiny), 1704067200000, 1704153600000, ["00000000000000007"], ["value"])._jdf.queryExecution().toString()
    assert "EqualTo(user_id,7)" in plan and "GreaterThanOrEqual(ts," in plan and "props" not in plan.split("ReadSchema")[1]


def test_latest_is_limited_before_the_shuffle(spark, tiny):
    plan = operators.latest(adapters.events(spark, tiny))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Python" not in plan


def test_stream_ingest_and_downsample(spark, tmp_path):
    (tmp_path / "db").mkdir()
    engine = Engine(spark, str(tmp_path / "db"), buckets=2).connect()
    engine.create_table("t", SCHEMA)
    made = [(f"v{n % 3}", 1000 * n, n, n / 2) for n in range(60)]
    spark.createDataFrame(made, "vin string, ts long, i int, d double").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("vin string, ts long, i int, d double").parquet(str(tmp_path / "in"))
    ingest(engine, "t", stream(), str(tmp_path / "ck")).awaitTermination()
    stored = engine.series("t")
    assert stored.df.count() == 60
    out = downsample_stream(stream(), "d", ColumnType.DOUBLE_FLOAT, MAX, 3500, 10_000, 0, CompareExpression(4.0, GT))
    query = out.writeStream.outputMode("complete").format("memory").queryName("down").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.vin, r.ts): r.d for r in spark.sql("SELECT * FROM down").collect()}
    want = {(r.vin, r.ts): r.d for r in operators.downsample(stored, "d", MAX, 3500, 63_500, 10_000, CompareExpression(4.0, GT)).collect()}
    assert got == want
