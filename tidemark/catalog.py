"""The registered queries of the time-series engine and their SQL.

They run over whole tables: every series of the events (or line items), by the operators' set-oriented
form. Keys ending in ``_one_series`` are the single requests, whose feature is to choose one series.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import operators, plans
from .engine import Engine
from .functions import passes
from .sources import Series, adapters
from .sources.scratch import scratch
from .types import Aggregator, ColumnType, CompareExpression, CompareOp, LatestQueryRequest, TimeRangeAggregationRequest, TimeRangeDownsampleRequest

AVG, MAX, EQ, GT = Aggregator.AVG, Aggregator.MAX, CompareOp.EQUAL, CompareOp.GREATER
Query = Callable[[SparkSession, str], DataFrame]

#: January 2024 from a begin that is no round number, in 30 buckets of a day; and ranges in it.
LO, DAY = 1704067200183, 86_400_000
HI, HOUR = LO + 30 * DAY, 3_600_000
#: Years of the line items' dates.
LINES_LO, LINES_HI = 631152000000, 631152000000 + 100 * 365 * DAY
VIN = "00000000000000007"

EVENTS = "(SELECT lpad(CAST(user_id AS VARCHAR), 17, '0') AS vin, epoch_us(ts) // 1000 AS ts, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type, event_id FROM events)"
LINES = "(SELECT lpad(CAST(l_suppkey AS VARCHAR), 17, '0') AS vin, epoch_us(l_shipdate) // 1000 AS ts, l_linenumber, l_quantity, l_extendedprice, l_returnflag, l_orderkey, l_partkey FROM lineitem)"


def _rounded(df: DataFrame, *names: str, digits: int = 9) -> DataFrame:
    """Averages to nine digits: engines add in different orders."""
    for n in names:
        df = df.withColumn(n, F.round(n, digits))
    return df


def _value(column: str, aggregator: Aggregator, test: CompareExpression | None) -> str:
    keep = f" FILTER (WHERE {column} {'=' if test.op is EQ else '>'} {test.value})" if test else ""
    if aggregator is AVG:
        return f"COALESCE(ROUND(AVG({column}){keep}, 9), CAST('-Infinity' AS DOUBLE)) AS {column}"
    none = "CAST(-2147483648 AS INTEGER)" if column in ("k", "l_linenumber") else "CAST('-Infinity' AS DOUBLE)"
    return f"COALESCE(MAX({column}){keep}, {none}) AS {column}"


def _aggregate(column: str, aggregator: Aggregator, lo: int = LO, hi: int = HI, vins=None, test=None, of=adapters.events, table: str = EVENTS) -> tuple[Query, str]:
    where = f" AND vin IN ({', '.join(map(repr, vins))})" if vins else ""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = operators.aggregate(of(spark, sf_dir), column, aggregator, lo, hi, vins, test)
        return _rounded(out, column) if aggregator is AVG else out

    return run, f"SELECT vin, CAST({lo} AS BIGINT) AS ts, {_value(column, aggregator, test)} FROM {table} WHERE ts >= {lo} AND ts < {hi}{where} GROUP BY vin"


def _downsample(column: str, aggregator: Aggregator, test=None, lo: int = LO, hi: int = HI, interval: int = DAY, vins=None, of=adapters.events, table: str = EVENTS) -> tuple[Query, str]:
    where = f" AND vin IN ({', '.join(map(repr, vins))})" if vins else ""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = operators.downsample(of(spark, sf_dir), column, aggregator, lo, hi, interval, test, vins)
        return _rounded(out, column) if aggregator is AVG else out

    sql = f"SELECT vin, CAST({lo} + ((ts - {lo}) // {interval}) * {interval} AS BIGINT) AS ts, {_value(column, aggregator, test)} FROM {table} WHERE ts >= {lo} AND ts < {hi}{where} GROUP BY vin, 2"
    return run, sql


def _range(lo: int, hi: int, columns=(), vins=None) -> tuple[Query, str]:
    where = f" AND vin IN ({', '.join(map(repr, vins))})" if vins else ""
    names = ", ".join(sorted(columns) or ("event_type", "k", "value"))
    return (lambda spark, sf_dir: operators.time_range(adapters.events(spark, sf_dir), lo, hi, vins, columns)), f"SELECT vin, ts, {names} FROM {EVENTS} WHERE ts >= {lo} AND ts < {hi}{where}"


def _latest(columns=(), vins=None) -> tuple[Query, str]:
    where = f"WHERE vin IN ({', '.join(map(repr, vins))})" if vins else ""
    names = ", ".join(sorted(columns) or ("event_type", "k", "value"))
    return (
        lambda spark, sf_dir: operators.latest(adapters.events(spark, sf_dir), vins, columns),
        f"SELECT vin, ts, {names} FROM (SELECT *, row_number() OVER (PARTITION BY vin ORDER BY ts DESC, event_id) AS nth FROM {EVENTS} {where}) WHERE nth = 1",
    )


def _bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each series a request from its third row to its last: the one at lo is kept, the one at hi dropped."""
    series = adapters.events(spark, sf_dir)
    times = series.frame(series.df, []).distinct().withColumn("place", F.row_number().over(Window.partitionBy("vin").orderBy("ts")))
    ends = times.groupBy("vin").agg(F.max(F.when(F.col("place") == 3, F.col("ts"))).alias("lo"), F.max("ts").alias("hi"), F.max("place").alias("n")).where("n > 3")
    asked = ends.select(F.col("vin").alias("request_id"), "vin", "lo", "hi")
    return operators.range_batch(series, asked, ["value"]).select("vin", "ts", "value")


BOUNDS_SQL = f"""
    WITH t AS (SELECT vin, list_sort(list(DISTINCT ts)) AS t FROM {EVENTS} GROUP BY vin)
    SELECT e.vin, e.ts, e.value FROM {EVENTS} e JOIN t USING (vin) WHERE len(t) > 3 AND e.ts >= t[3] AND e.ts < t[-1]"""


def _requests(spark: SparkSession, sf_dir: str, interval: bool) -> tuple[Series, DataFrame]:
    """Two requests for each user: the first ten days and the ten around the middle."""
    series = adapters.events(spark, sf_dir)
    users = series.frame(series.df, []).select("vin").distinct()
    spans = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(a).cast("long").alias("lo"), F.lit(a + 10 * DAY).cast("long").alias("hi")) for n, a in enumerate((LO, LO + 12 * DAY))]))
    asked = users.select("vin", spans.alias("s")).select(F.concat_ws("-", "vin", "s.n").alias("request_id"), "vin", "s.lo", "s.hi")
    return series, asked.withColumn("interval", F.lit(12 * HOUR).cast("long")) if interval else asked


REQUESTS_SQL = f"(SELECT concat(vin, '-', n) AS request_id, vin AS asked, lo, lo + 10 * CAST({DAY} AS BIGINT) AS hi FROM (SELECT DISTINCT vin FROM {EVENTS}), (VALUES (0, {LO}), (1, {LO + 12 * DAY})) s(n, lo))"


def _batch(kind: str) -> tuple[Query, str]:
    met = f"FROM {EVENTS} JOIN {REQUESTS_SQL} ON vin = asked AND ts >= lo AND ts < hi"
    if kind == "range":
        return lambda spark, sf_dir: operators.range_batch(*_requests(spark, sf_dir, False), ["value", "k"]), f"SELECT request_id, vin, ts, k, value {met}"
    if kind == "aggregate":
        return lambda spark, sf_dir: _rounded(operators.aggregate_batch(*_requests(spark, sf_dir, False), "value", AVG), "value"), f"SELECT request_id, vin, lo AS ts, ROUND(AVG(value), 9) AS value {met} GROUP BY request_id, vin, lo"
    test = CompareExpression(50, GT)
    return (
        lambda spark, sf_dir: operators.downsample_batch(*_requests(spark, sf_dir, True), "k", MAX, test),
        f"SELECT request_id, vin, CAST(lo + ((ts - lo) // {12 * HOUR}) * {12 * HOUR} AS BIGINT) AS ts, {_value('k', MAX, test)} {met} GROUP BY request_id, vin, 3",
    )


#: Blocks of the stored tables' rollups.
STORED_BLOCK = 6 * HOUR


def _rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup that appends have kept: a row for each append, added up."""
    engine = stored(spark, sf_dir, writes=2)
    rollup = engine.store.rollup("events", engine.tables["events"])
    return _rounded(rollup.groupBy("vin", "block_start").agg(F.sum("n_value").alias("n"), F.sum("total_value").alias("total"), F.max("most_value").alias("most")), "total", digits=6)


def _with_rollup(down: bool, column: str, aggregator: Aggregator) -> tuple[Query, str]:
    """A request for all series to the engine, which takes whole blocks from the stored rollups."""
    lo = LO - 183 if down else LO
    hi = lo + 30 * DAY

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = stored(spark, sf_dir, writes=2)
        if down:
            out = engine.downsample(TimeRangeDownsampleRequest("events", VIN, column, lo, hi, aggregator, DAY), None)
        else:
            out = engine.aggregate(TimeRangeAggregationRequest("events", VIN, column, lo, hi, aggregator), None)
        return _rounded(out, column) if aggregator is AVG else out

    return run, (_downsample(column, aggregator, lo=lo, hi=hi) if down else _aggregate(column, aggregator, lo, hi))[1]


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all series, from the newest rows that appends have kept."""
    engine = stored(spark, sf_dir, writes=2)
    return operators.latest(engine.store.newest("events", engine.tables["events"]))


def _merged_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest rows of the first half of the month, merged with those of all later rows."""
    series = adapters.events(spark, sf_dir)
    half = LO + 15 * DAY
    part = lambda a, b: replace(series, df=series.within(series.df, a, b))
    return plans.merge_latest(operators.latest(part(0, half)), part(half, 4102444800000))


def _predicate(op: CompareOp, value: float) -> tuple[Query, str]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        series = adapters.events(spark, sf_dir)
        rows = series.frame(series.df, ["value"])
        return rows.where(passes(F.col("value"), ColumnType.DOUBLE_FLOAT, CompareExpression(value, op)))

    return run, f"SELECT vin, ts, value FROM {EVENTS} WHERE value {'=' if op is EQ else '>'} {value}"


def _ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.latest(adapters.lineitems(spark, sf_dir), None, ["l_quantity", "l_linenumber", "l_returnflag"])


TIES_SQL = f"SELECT vin, ts, l_linenumber, l_quantity, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY vin ORDER BY ts DESC, l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice) AS nth FROM {LINES}) WHERE nth = 1"


_STORED: dict[tuple, str] = {}


def stored(spark: SparkSession, sf_dir: str, writes: int = 1, dedup: str | None = None, buckets: int = 16) -> Engine:
    """The events in a database of 16 buckets, written in so many appends once a session, and now opened again.

    With ``dedup`` the first append has other values for every row, which the last one overwrites.
    """
    key = (spark.sparkContext.applicationId, sf_dir, writes, dedup)
    if key not in _STORED:
        series, path = adapters.events(spark, sf_dir), scratch(spark)
        first = Engine(spark, path, buckets=16, block=STORED_BLOCK).connect()
        first.create_table("events", series.schema)
        rows = series.frame(series.df, list(series.schema.columns))
        for n in range(writes):
            if dedup:
                part = rows if n == writes - 1 else rows.withColumns({"k": F.col("k") + 1000 + n, "value": -F.col("value"), "event_type": F.lit("none")})
            else:
                part = rows.where(F.pmod(F.xxhash64("vin", "ts"), F.lit(writes)) == n)
            first.write_frame("events", part)
        first.shutdown()
        _STORED[key] = path
    return Engine(spark, _STORED[key], buckets=buckets, dedup=dedup).connect()


def _created(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that an engine has made, as another one finds them."""
    path = scratch(spark)
    engine = Engine(spark, path).connect()
    engine.create_table("events", adapters.events(spark, sf_dir).schema)
    engine.create_table("orders", adapters.orders(spark, sf_dir).schema)
    found = Engine(spark, path).connect().schemas
    return spark.createDataFrame([(t, n, k.name) for t, schema in found.items() for n, k in schema.columns.items()], "table_name string, name string, type string")


CREATED_SQL = """SELECT * FROM (VALUES ('events', 'event_type', 'STRING'), ('events', 'k', 'INTEGER'), ('events', 'value', 'DOUBLE_FLOAT'),
    ('orders', 'o_orderstatus', 'STRING'), ('orders', 'o_totalprice', 'DOUBLE_FLOAT')) t(table_name, name, type)"""


def _reopened_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = stored(spark, sf_dir)
    return spark.createDataFrame([(n, t.name) for n, t in engine.schemas["events"].columns.items()], "name string, type string")


SCHEMA_SQL = "SELECT * FROM (VALUES ('event_type', 'STRING'), ('k', 'INTEGER'), ('value', 'DOUBLE_FLOAT')) t(name, type)"


def _other_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a database of 16 buckets, opened by an engine set to 64: rows of ten series, one after the other."""
    series = stored(spark, sf_dir, buckets=64).series("events")
    parts = [operators.time_range(series, LO, HI, [f"{n:017d}"], ["k"]) for n in range(1, 11)]
    return reduce(DataFrame.union, parts)


def _counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an engine has counted of its appends."""
    series, path = adapters.events(spark, sf_dir), scratch(spark)
    engine = Engine(spark, path, buckets=16).connect()
    engine.create_table("events", series.schema)
    rows = series.frame(series.df, list(series.schema.columns))
    for n in range(2):
        engine.write_frame("events", rows.where(F.pmod(F.xxhash64("vin", "ts"), F.lit(2)) == n))
    seen = engine.stats["events"]
    return spark.createDataFrame([(seen["rows"], seen["from"], seen["to"])], "n long, first long, last long")


def _entries() -> dict[str, tuple[Query, str]]:
    e = lambda v, op: CompareExpression(v, op)
    one = [VIN]
    named = {f"q4_{a.name.lower()}_{kind}_{op}": _downsample(column, a, e(value, EQ if op == "eq" else GT)) for a in (AVG, MAX) for kind, column in (("int", "k"), ("double", "value")) for op, value in (("eq", 20 if kind == "int" else 26.17), ("gt", 50 if kind == "int" else 20.5))}
    return {
        "q1_latest_all": _latest(),
        "q1_latest_projected": _latest(["value"]),
        "q1_latest_missing_vin": _latest(["value"], [VIN, "no such vin", "00000000000000011"]),
        "q1_latest_duplicate_vins": _latest((), [VIN, VIN, "00000000000000011"]),
        "q1_latest_ties": (_ties, TIES_SQL),
        "q2_range_projected": _range(LO, HI, ["value"]),
        "q2_range_all": _range(LO + 3 * DAY, LO + 20 * DAY),
        "q2_range_bounds": (_bounds, BOUNDS_SQL),
        "q2_range_empty": _range(0, 1000),
        "q2_range_lines": (
            lambda spark, sf_dir: operators.time_range(adapters.lineitems(spark, sf_dir), LINES_LO, LINES_HI, None, ["l_linenumber", "l_quantity"]),
            f"SELECT vin, ts, l_linenumber, l_quantity FROM {LINES} WHERE ts >= {LINES_LO} AND ts < {LINES_HI}",
        ),
        "q2_range_one_series": _range(LO, HI, ["k"], one),
        "q3_avg_double": _aggregate("value", AVG),
        "q3_avg_int": _aggregate("k", AVG),
        "q3_max_double": _aggregate("value", MAX),
        "q3_max_int": _aggregate("k", MAX),
        "q3_empty_range": _aggregate("value", MAX, 0, 1000),
        "q3_unknown_vin": _aggregate("value", AVG, vins=["no such vin"]),
        "q3_one_series": _aggregate("value", AVG, vins=one),
        "q3_max_int_lines": _aggregate("l_linenumber", MAX, LINES_LO, LINES_HI, of=adapters.lineitems, table=LINES),
        **named,
        "q4_sentinel_bucket": _downsample("value", AVG, e(1e9, GT)),
        "q4_gap_bucket_absent": _downsample("value", AVG, interval=HOUR),
        "q4_empty_range": _downsample("value", AVG, lo=0, hi=DAY),
        "q4_unanchored_lo": _downsample("value", MAX, lo=LO + 777_777, hi=LO + 777_777 + 20 * DAY, interval=5 * HOUR),
        "q4_one_series": _downsample("value", AVG, e(20.5, GT), vins=one, interval=6 * HOUR),
        "q4_lines_yearly": _downsample("l_quantity", AVG, e(25.0, GT), LINES_LO, LINES_HI, 365 * DAY, of=adapters.lineitems, table=LINES),
        "x1_range_batch": _batch("range"),
        "x1_aggregate_batch": _batch("aggregate"),
        "x1_downsample_batch": _batch("downsample"),
        "l2_connect_latest": (lambda spark, sf_dir: operators.latest(stored(spark, sf_dir).series("events")), _latest()[1]),
        "l3_create_table": (_created, CREATED_SQL),
        "l5_write": (lambda spark, sf_dir: operators.time_range(stored(spark, sf_dir).series("events"), 0, 4102444800000), _range(0, 4102444800000)[1]),
        "l6_other_buckets": (_other_buckets, _range(LO, HI, ["k"], [f"{n:017d}" for n in range(1, 11)])[1]),
        "l9_schema_reload": (_reopened_schema, SCHEMA_SQL),
        "s3_stored_range": (lambda spark, sf_dir: operators.time_range(stored(spark, sf_dir).series("events"), LO + 5 * DAY, LO + 6 * DAY), _range(LO + 5 * DAY, LO + 6 * DAY)[1]),
        "s6_two_appends": (lambda spark, sf_dir: operators.time_range(stored(spark, sf_dir, 2).series("events"), LO, HI, None, ["value"]), _range(LO, HI, ["value"])[1]),
        "d4_last_write": (lambda spark, sf_dir: operators.time_range(stored(spark, sf_dir, 2, "last").series("events"), LO, HI), _range(LO, HI)[1]),
        "d4_last_write_latest": (lambda spark, sf_dir: stored(spark, sf_dir, 2, "last").execute_latest_query(LatestQueryRequest("events", [f"{n:017d}" for n in range(1, 2000)])), _latest((), [f"{n:017d}" for n in range(1, 2000)])[1]),
        "c5_timestamps_lossless": (lambda spark, sf_dir: _rounded(operators.downsample(stored(spark, sf_dir).series("events"), "value", AVG, LO, HI, DAY, CompareExpression(20.5, GT)), "value"), _downsample("value", AVG, CompareExpression(20.5, GT))[1]),
        "l7_rollup": (_rollup, f"SELECT vin, ts - ts % {STORED_BLOCK} AS block_start, count(*) AS n, ROUND(sum(value), 6) AS total, max(value) AS most FROM {EVENTS} GROUP BY vin, 2"),
        "l10_latest_snapshot": (_snapshot, _latest()[1]),
        "l10_merged_snapshot": (_merged_snapshot, _latest()[1]),
        "e8_counters": (_counters, f"SELECT count(*) AS n, min(ts) AS first, max(ts) AS last FROM {EVENTS}"),
        "s1_series_lookup": _range(0, 4102444800000, (), one),
        "s2_time_filter": _range(LO + 5 * DAY, LO + 6 * DAY),
        "s5_projection": _range(0, 4102444800000, ["k", "event_type"]),
        "p1_equal": _predicate(EQ, 26.17),
        "p2_greater": _predicate(GT, 100.0),
        "a1_avg": _aggregate("l_quantity", AVG, LINES_LO, LINES_HI, of=adapters.lineitems, table=LINES),
        "a2_max": _aggregate("value", MAX, LO + DAY, LO + 9 * DAY),
        "a3_filtered_avg": _aggregate("value", AVG, test=e(20.5, GT)),
        "a3_filtered_max_none": _aggregate("k", MAX, test=e(1000, GT)),
        "a4_rollup_aggregate": _with_rollup(False, "value", AVG),
        "a4_rollup_aggregate_int": _with_rollup(False, "k", MAX),
        "a4_rollup_downsample": _with_rollup(True, "value", MAX),
        "a4_rollup_downsample_avg": _with_rollup(True, "k", AVG),
    }


def queries() -> dict[str, Query]:
    return {name: run for name, (run, _) in _entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _entries().items()}
