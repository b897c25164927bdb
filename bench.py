"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then ``RUNS`` times; its figure is the median. Results go to Spark's
noop sink, so that every column of every row is made and nothing is collected. ``rows_per_sec`` are input
rows over seconds, the way the published figures count. The first queries read the tables as they are; those named ``stored_``
go through an engine whose tables hold the line items, with rollups of a year and newest rows, and ``write_lines`` writes them
anew each time. ``compression`` is the stored bytes over the values' own (8 a time or double, 4 an integer, 17 a key, a string's length).
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark import Aggregator, CompareExpression, CompareOp, Engine, LatestQueryRequest, TimeRangeAggregationRequest, TimeRangeDownsampleRequest, catalog, operators
from tidemark.sources import adapters

RUNS = 3
QUERIES = ("q1_latest_all", "q1_latest_ties", "q2_range_all", "q2_range_lines", "q3_avg_double", "q3_max_int_lines", "q4_avg_double_gt", "q4_max_int_gt", "q4_lines_yearly", "x1_downsample_batch", "a4_rollup_downsample")
YEAR, LINES, VIN = 365 * catalog.DAY, "lines", "00000000000000007"
LO, HI = 22 * YEAR, 32 * YEAR  # whole blocks around the line items' dates


def lines_engine(spark: SparkSession, sf_dir: str, path: str) -> Engine:
    series = adapters.lineitems(spark, sf_dir)
    engine = Engine(spark, path, buckets=16, block=YEAR).connect()
    engine.create_table(LINES, series.schema)
    engine.write_frame(LINES, series.frame(series.df, list(series.schema.columns)))
    return engine


def stored_queries(engine: Engine) -> dict:
    """Over all series, of the stored line items."""
    aggregate = lambda column, a: engine.aggregate(TimeRangeAggregationRequest(LINES, VIN, column, LO, HI, a), None)
    vins = [r[0] for r in engine.series(LINES).df.select("vin").distinct().collect()]
    return {
        "stored_latest": lambda: engine.execute_latest_query(LatestQueryRequest(LINES, vins)),
        "stored_range": lambda: operators.time_range(engine.series(LINES), LO, HI, None, ["l_linenumber", "l_quantity"]),
        "stored_avg": lambda: aggregate("l_quantity", Aggregator.AVG),
        "stored_max_int": lambda: aggregate("l_linenumber", Aggregator.MAX),
        "stored_downsample": lambda: engine.downsample(TimeRangeDownsampleRequest(LINES, VIN, "l_quantity", LO, HI, Aggregator.AVG, YEAR), None),
        "stored_downsample_gt": lambda: engine.downsample(TimeRangeDownsampleRequest(LINES, VIN, "l_quantity", LO, HI, Aggregator.AVG, YEAR, CompareExpression(25.0, CompareOp.GREATER)), None),
    }


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    counts = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("events", "lineitem")}
    seconds, rate, base = {}, {}, tempfile.mkdtemp(prefix="bench-")

    def timed(name: str, rows: int, run) -> None:
        took = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            run()
            took.append(time.perf_counter() - start)
        seconds[name] = round(median(took[1:]), 4)
        rate[name] = round(rows / seconds[name])

    drain = lambda df: df.write.format("noop").mode("overwrite").save()
    for name in QUERIES:
        timed(name, counts["lineitem" if "lines" in name or "ties" in name else "events"], lambda name=name: drain(catalog.queries()[name](spark, sf_dir)))
    timed("write_lines", counts["lineitem"], lambda: lines_engine(spark, sf_dir, tempfile.mkdtemp(dir=base)))
    path = tempfile.mkdtemp(dir=base)
    engine = lines_engine(spark, sf_dir, path)
    for name, run in stored_queries(engine).items():
        timed(name, counts["lineitem"], lambda run=run: drain(run()))
    df = engine.series(LINES).df
    own = df.agg(F.sum(F.lit(17 + 8 + 8 + 8 + 4) + F.octet_length("l_returnflag"))).first()[0]
    kept = sum(f.stat().st_size for f in Path(path, LINES).rglob("*.parquet"))
    spark.stop()
    shutil.rmtree(base, ignore_errors=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "rows_per_sec": rate, "compression": round(kept / own, 3), "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
