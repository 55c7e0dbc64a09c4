"""Ridership views over the provided tables (FIXTURES.md section 2).

``rides_events``: hourly rides from ``events`` (station = user_id mod 25).
``rides_orders``: daily rides from ``orders`` joined to customer, nation and region.

Both produce the raw ridership schema (``schemas.RAW_RIDES``), with the
timestamp as text exactly as the raw files carry it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.functions.timefmt import format_transit_ts, hour_floor
from turnstile.schemas import RIDE_COLUMNS
from turnstile.session import materialize, scratch_path
from turnstile.sources import files
from turnstile.sources.tables import read_table

# Adapter constants.
N_EVENT_STATIONS = 25
N_EVENT_BOROUGHS = 5
STATION_NAME_MOD = 7
TRAM_STATION = 24


def station_latitude(k) -> Column:
    """40.5 + k * 0.01, computed as (4050 + k) / 100 so every engine rounds alike."""
    return (F.lit(4050) + k).cast("double") / F.lit(100.0)


def station_longitude(k) -> Column:
    """-74.0 + k * 0.01."""
    return (F.lit(-7400) + k).cast("double") / F.lit(100.0)


def event_station(user_id="user_id") -> Column:
    return F.col(user_id) % N_EVENT_STATIONS


def rides_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    k = event_station()
    omny = (F.col("event_id") % 2) == 0
    return ev.select(
        F.col("event_id").alias("ride_id"),
        format_transit_ts(hour_floor("ts")).alias("transit_timestamp"),
        F.when(k == TRAM_STATION, F.lit("tram")).otherwise(F.lit("subway")).alias("transit_mode"),
        k.cast("string").alias("station_complex_id"),
        F.format_string("Stop %d (%d)", k, k % STATION_NAME_MOD).alias("station_complex"),
        F.format_string("Borough %d", k % N_EVENT_BOROUGHS).alias("borough"),
        F.when(omny, F.lit("omny")).otherwise(F.lit("metrocard")).alias("payment_method"),
        F.concat(F.when(omny, F.lit("OMNY - ")).otherwise(F.lit("Metrocard - ")),
                 F.col("event_type"), F.lit(" & x")).alias("fare_class_category"),
        F.floor("value").cast("long").alias("ridership"),
        station_latitude(k).alias("latitude"),
        station_longitude(k).alias("longitude"),
    )


def rides_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders",
                        ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])
    customer = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    region = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    # Spark picks each join from the tables' sizes: nation and region are tiny, orders x customer is a shuffle join.
    j = (orders.join(customer, orders.o_custkey == customer.c_custkey)
         .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
         .join(region, F.col("n_regionkey") == F.col("r_regionkey")))
    k = F.col("n_nationkey")
    return j.select(
        F.col("o_orderkey").alias("ride_id"),
        format_transit_ts("o_orderdate").alias("transit_timestamp"),
        F.lit("subway").alias("transit_mode"),
        k.cast("string").alias("station_complex_id"),
        F.col("n_name").alias("station_complex"),
        F.col("r_name").alias("borough"),
        F.col("o_orderstatus").alias("payment_method"),
        F.col("o_orderpriority").alias("fare_class_category"),
        F.floor("o_totalprice").cast("long").alias("ridership"),
        station_latitude(k).alias("latitude"),
        station_longitude(k).alias("longitude"),
    )


VIEWS = {"events": rides_events, "orders": rides_orders}


def rides(spark: SparkSession, sf_dir: str, view: str = "events") -> DataFrame:
    df = VIEWS[view](spark, sf_dir)
    assert df.columns == RIDE_COLUMNS
    return df


# Typed sinks and station lists by application, folder and view: landed once, read by every series query.
_TYPED: dict[tuple[str, str, str], tuple[DataFrame, DataFrame]] = {}


def typed_rides(spark: SparkSession, sf_dir: str, view: str = "events") -> tuple[DataFrame, DataFrame]:
    """The view landed in the typed sink, and the ids and names of its stations."""
    key = (spark.sparkContext.applicationId, sf_dir, view)
    if key not in _TYPED:
        path = scratch_path(spark, f"typed_{view}")
        files.write_typed(rides(spark, sf_dir, view), path)
        typed = files.read_typed(spark, path)
        _TYPED[key] = typed, materialize(typed.select("station_complex_id", "station_complex").distinct(), "stations")
    return _TYPED[key]
