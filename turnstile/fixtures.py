"""Inputs that the provided tables do not hold, derived from them by Spark.

Weather rows, landed weather replies, scoring requests and arriving files of
FIXTURES.md: they feed the registered queries and tests and are no part of
the library's operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.functions.timefmt import parse_transit_ts
from turnstile.operators.weather import typed_weather
from turnstile.schemas import RAW_RIDES, WEATHER_TS_FORMAT

# The derived-weather formula (FIXTURES.md section 2).
WEATHER_EPOCH = "2024-01-01"
MISSING_EVERY = 10          # (h + k) % 10 == 0 -> no observation (left-join miss)
NA_EVERY = 97               # (7h + k) % 97 == 0 -> temperature text "n/a"
FAILED_REPLY_EVERY = 11     # (month + station_id) % 11 == 0 -> reply status 500

# Rules that make some derived requests invalid, so every
# rejection path is exercised by the registered query.
UNKNOWN_STATION_EVERY = 31     # ride_id % 31 == 0 -> unknown station
BAD_DATE_EVERY = 97            # event_id % 97 == 0 -> "2024-02-30"
UNKNOWN_FARE_EVERY = 53        # event_id % 53 == 0 -> unknown fare class
UNKNOWN_PAYMENT_EVERY = 41     # event_id % 41 == 0 -> "cash"


def station_days(rides_ts: DataFrame) -> DataFrame:
    """First and last ride day per station coordinate (one row per station)."""
    return (rides_ts.groupBy("station_complex_id", "latitude", "longitude")
            .agg(F.min(F.to_date("ts")).alias("first_day"), F.max(F.to_date("ts")).alias("last_day")))


def derive_weather(rides_ts: DataFrame) -> DataFrame:
    """Weather CSV rows (all measures as text) for every station hour of the data.

    Per station: ``explode(sequence(0, hours-1))`` over its day span. No cross
    join; the station table is one row per station.
    """
    days = station_days(rides_ts).filter(F.col("first_day").isNotNull())
    k = F.col("station_complex_id").cast("long")
    start = F.make_timestamp_ntz(F.year("first_day"), F.month("first_day"), F.dayofmonth("first_day"),
                                 F.lit(0), F.lit(0), F.lit(0))
    n_hours = (F.datediff("last_day", "first_day") + 1) * 24
    hours = days.select(k.alias("k"), "latitude", "longitude", start.alias("start"),
                        F.explode(F.sequence(F.lit(0), n_hours - 1)).alias("i"))
    t = F.timestamp_add("HOUR", F.col("i"), F.col("start"))
    hours = hours.select("k", "latitude", "longitude", t.alias("t"))
    h = F.datediff(F.to_date("t"), F.lit(WEATHER_EPOCH)).cast("long") * 24 + F.hour("t")
    hours = hours.withColumn("h", h)
    hk = F.col("h") + F.col("k")
    temp = F.when((F.col("h") * 7 + F.col("k")) % NA_EVERY == 0, F.lit("n/a")).otherwise(
        ((F.col("h") * 7 + F.col("k") * 3) % 45 - 8).cast("string"))
    return hours.filter(hk % MISSING_EVERY != 0).select(
        F.date_format("t", WEATHER_TS_FORMAT).alias("time"),
        temp.alias("temperature_C"),
        ((F.col("h") * 5 + F.col("k")) % 13).cast("string").alias("precipitation_mm"),
        (F.lit(30) + (F.col("h") * 3 + F.col("k")) % 70).cast("string").alias("humidity_%"),
        (F.col("k") + 1).alias("station_id"),
        "latitude", "longitude",
    )


def _field(name: str):
    return lambda o: o.getField(name)


def land_replies(weather_text: DataFrame, path: str) -> None:
    """Write one reply file per station and month, as a download leaves them.

    A body has the grid point's coordinates and the hourly arrays (at most 744
    hours), and neither station nor status: these are in the folder names.
    Some requests have failed and left an error body.
    """
    w = typed_weather(weather_text)
    month = F.date_trunc("month", "weather_ts").cast("date")
    per_month = (w.groupBy("station_id", "latitude", "longitude", month.alias("month"))
                 .agg(F.array_sort(F.collect_list(F.struct(
                     F.date_format("weather_ts", WEATHER_TS_FORMAT).alias("time"),
                     F.col("temperature_C").alias("temperature_2m"),
                     F.col("precipitation_mm").alias("precipitation"),
                     F.col("humidity_%").alias("relative_humidity_2m")))).alias("obs")))
    failed = (F.month("month") + F.col("station_id")) % FAILED_REPLY_EVERY == 0
    hourly = F.struct(*[F.transform("obs", _field(f)).alias(f)
                        for f in ["time", "temperature_2m", "precipitation", "relative_humidity_2m"]])
    body = F.when(failed, F.lit('{"error":true,"reason":"request limit exceeded"}')).otherwise(
        F.to_json(F.struct(F.round("latitude", 1).alias("latitude"), F.round("longitude", 1).alias("longitude"), hourly.alias("hourly"))))
    replies = per_month.select("station_id", F.date_format("month", "yyyy-MM-dd").alias("start_date"),
                               F.when(failed, F.lit(500)).otherwise(F.lit(200)).alias("status"), body.alias("value"))
    replies.repartition("station_id", "start_date").write.mode("overwrite").partitionBy("status", "station_id", "start_date").text(path)


def requests_from_rides(rides: DataFrame) -> DataFrame:
    """One request per ride of the events view, in user units (°F, inches)."""
    ts = parse_transit_ts("transit_timestamp")
    rid = F.col("ride_id")
    return rides.select(
        rid.alias("request_id"),
        F.when(rid % UNKNOWN_STATION_EVERY == 0, F.lit("Unknown Stop"))
         .otherwise(F.col("station_complex")).alias("station"),
        F.when(rid % BAD_DATE_EVERY == 0, F.lit("2024-02-30")).otherwise(F.date_format(ts, "yyyy-MM-dd")).alias("date"),
        F.date_format(ts, "HH:mm:ss").alias("time"),
        ((F.col("ridership") % 140) - 20).cast("double").alias("temp_f"),
        (F.col("ridership") % 107).cast("double").alias("humidity"),
        ((F.col("ridership") % 11) / F.lit(2.0)).alias("precipitation_in"),
        F.when(rid % UNKNOWN_FARE_EVERY == 0, F.lit("Bus - Full Fare")).otherwise(F.col("fare_class_category")).alias("fare_class"),
        F.when(rid % UNKNOWN_PAYMENT_EVERY == 0, F.lit("cash")).otherwise(F.col("payment_method")).alias("payment_method"),
    )


def land_files(rides: DataFrame, landing_dir: str, n_files: int = 4) -> None:
    """Write rides as ``n_files`` Parquet files in time order (a stand-in for arriving data)."""
    (rides.select(*[F.col(f.name) for f in RAW_RIDES.fields])
     .repartitionByRange(n_files, "ride_id").write.mode("overwrite").parquet(landing_dir))


# Column order of the published ridership files.
PUBLISHED_LAYOUT = ["transit_timestamp", "transit_mode", "station_complex_id", "station_complex", "borough",
                    "payment_method", "fare_class_category", "ridership", "latitude", "longitude", "Georeference"]


def published(rides: DataFrame) -> DataFrame:
    """Rides in the published layout: no id, a ``Georeference`` column."""
    point = F.format_string("POINT (%s %s)", F.col("longitude").cast("string"), F.col("latitude").cast("string"))
    return rides.withColumn("Georeference", point).select(*PUBLISHED_LAYOUT)


def land_mixed_csv(rides: DataFrame, path: str) -> list[str]:
    """Three CSV folders of a third of the rides each: published layout, reversed layout
    without ``Georeference``, and one whose rows of every seventh ride have a comma too many."""
    parts = [f"{path}/layout={n}" for n in ("published", "reversed", "broken")]
    kind = F.col("ride_id") % 3
    comma = F.when(F.col("ride_id") % 7 == 0, F.concat("station_complex", F.lit(",x"))).otherwise(F.col("station_complex"))
    frames = [published(rides.filter(kind == 0)), published(rides.filter(kind == 1)).select(*PUBLISHED_LAYOUT[-2::-1]),
              published(rides.filter(kind == 2).withColumn("station_complex", comma))]
    for df, to, quote in zip(frames, parts, ('"', '"', "")):
        df.write.mode("overwrite").option("header", True).option("quote", quote).csv(to)
    return parts
