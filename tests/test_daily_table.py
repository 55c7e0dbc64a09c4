"""Typed sink, pruned series and the stored daily table."""

import os
import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF_SMALL
from turnstile.operators import daily, daily_table
from turnstile.operators.ranking import with_ts
from turnstile.sources import files
from turnstile.sources.adapters import rides, typed_rides

QUERIES = entry.queries()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _files(path):
    """Every data file of a table with its time of writing."""
    return {f"{d}/{n}": os.stat(f"{d}/{n}").st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_series_read_only_the_folders_asked_for(spark):
    for name in ("station_daily_series", "station_daily_series_by_name", "chart_titles", "series_x_ticks"):
        assert re.search(r"PartitionFilters: \[[^\]]*year#\d+ = ", _plan(QUERIES[name](spark, SF_SMALL))), name
    plan = _plan(QUERIES["station_daily_series"](spark, SF_SMALL))
    assert re.search(r"PartitionFilters: \[[^\]]*month#\d+ = 1", plan) and "PushedFilters: [IsNotNull(fare_class_category)" in plan
    assert re.search(r"PartitionFilters: \[[^\]]*date#\d+ >= 2024-01-01", _plan(QUERIES["station_daily_series_all"](spark, SF_SMALL)))


def test_typed_sink_keeps_every_row_and_its_time(spark, tmp_path):
    r = rides(spark, SF_SMALL, "events").withColumn(
        "transit_timestamp", F.when(F.col("ride_id") % 50 == 0, "no time").otherwise(F.col("transit_timestamp")))
    path = str(tmp_path / "typed")
    files.write_typed(r, path)
    cols = ["ride_id", "ts", "station_complex", "ridership", "latitude"]
    back, plain = files.read_typed(spark, path).select(*cols), with_ts(r).select(*cols)
    assert back.exceptAll(plain).isEmpty() and plain.exceptAll(back).isEmpty()
    assert back.filter("ts is null").count() == r.filter("ride_id % 50 = 0").count() > 0


def test_refresh_touches_changed_days_alone_and_can_be_repeated(spark, tmp_path):
    rides_ts, _ = typed_rides(spark, SF_SMALL, "events")
    sink, table = str(tmp_path / "facts"), str(tmp_path / "daily")
    late = (F.to_date("ts") == F.lit("2024-01-05").cast("date")) & (F.col("ride_id") % 2 == 0)
    no_time = rides_ts.limit(3).withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    files.write_typed(rides_ts.filter(~late), sink)
    daily_table.write(files.read_typed(spark, sink), table)
    before = _files(table)
    new = rides_ts.filter(late).unionByName(no_time)
    files.write_typed(new, sink, mode="append")
    days = daily_table.changed_days(new)
    assert len(days) == 2 and None in days
    for _ in range(2):                                     # a repeated refresh changes nothing
        daily_table.refresh(files.read_typed(spark, sink), table, days)
        full = daily.daily_ridership(files.read_typed(spark, sink)).select(*daily.DAILY_KEYS, "daily_ridership")
        kept = daily_table.read(spark, table)
        assert kept.exceptAll(full).isEmpty() and full.exceptAll(kept).isEmpty()
    after = _files(table)
    assert {f for f in before if after.get(f) != before[f]} == {f for f in before if "date=2024-01-05" in f}


def test_refresh_reads_the_changed_months_alone(spark, tmp_path):
    rides_ts, _ = typed_rides(spark, SF_SMALL, "orders")
    sink = str(tmp_path / "facts")
    files.write_typed(rides_ts, sink)
    seen = []
    keep, daily_table._write = daily_table._write, lambda df, path, how: seen.append(_plan(df))
    try:
        daily_table.refresh(files.read_typed(spark, sink), "unused", [rides_ts.agg(F.max(F.to_date("ts"))).first()[0]])
    finally:
        daily_table._write = keep
    assert re.search(r"PartitionFilters: \[[^\]]*year#\d+ = \d+[^\]]*month#\d+ = ", seen[0])
