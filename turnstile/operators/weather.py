"""Hourly weather: landed replies, typing and the fact join
(A2, A5, A6, A7, B3, B4, B5, C1, G1, H3, H4, H13, J8).

Downloads land one reply file per request.  A reply's body knows neither its
station nor its status; both come from the folders it was landed in, and the
station's coordinates from the table the requests were made from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.functions.numeric import to_double
from turnstile.functions.timefmt import parse_weather_time
from turnstile.schemas import WEATHER_MEASURES, WEATHER_REPLY_BODY
from turnstile.sources.files import read_weather_csv

MICRO_DEGREES = 1_000_000


def typed_weather(weather_text: DataFrame) -> DataFrame:
    """Measures text -> double (``try_cast``: "n/a" -> null), time -> timestamp."""
    return weather_text.select(
        parse_weather_time("time").alias("weather_ts"),
        *[to_double(c).alias(c) for c in WEATHER_MEASURES],
        F.col("station_id").cast("long").alias("station_id"),
        F.col("latitude").cast("double").alias("latitude"),
        F.col("longitude").cast("double").alias("longitude"),
    )


# --- landed replies (A5-A7) ------------------------------------------------------------

def station_coordinates(rides: DataFrame) -> DataFrame:
    """The table that requests are made from: one row per station.

    A station has the number that requests give it, its id plus one; of
    several coordinates the smallest stands for the station.
    """
    return (rides.groupBy((F.col("station_complex_id").try_cast("long") + 1).alias("station_id"))
            .agg(F.min(F.struct("latitude", "longitude")).alias("at")).filter("station_id is not null")
            .select("station_id", "at.latitude", "at.longitude"))


def read_reply_files(spark: SparkSession, path: str) -> DataFrame:
    """Landed reply files with a fixed schema, one reply per file.

    ``status``, ``station_id`` and ``start_date`` come from the folder names,
    ``origin`` is the file; a body that is no JSON stands in ``unreadable``.
    """
    body = spark.read.schema(WEATHER_REPLY_BODY).option("wholetext", False).option("columnNameOfCorruptRecord", "unreadable").json(path)
    return body.select(F.col("station_id").cast("long").alias("station_id"), F.col("start_date").cast("string").alias("start_date"),
                       F.col("status").cast("int").alias("status"), F.col("_metadata.file_path").alias("origin"),
                       "hourly", "reason", "unreadable")


def accepted(replies: DataFrame) -> Column:
    """Whether a reply is usable: never null, so each reply is accepted or rejected.

    A reply of unknown status is judged by its data.
    """
    return ((F.coalesce(F.col("status"), F.lit(200)) == 200) & F.col("hourly").isNotNull() & F.col("hourly.time").isNotNull())


def flatten_replies(replies: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Accepted replies -> one row per hour (A5): parallel arrays zipped, nulls kept.

    Coordinates are those of the request's station, not the grid point of the
    reply; a station that is not in the table has none.
    """
    ok = replies.filter(accepted(replies))
    zipped = ok.select("station_id", F.inline(F.arrays_zip("hourly.time", "hourly.temperature_2m",
                                                           "hourly.precipitation", "hourly.relative_humidity_2m")))
    hours = zipped.select(
        "station_id", F.col("time"),
        F.col("temperature_2m").alias("temperature_C"),
        F.col("precipitation").alias("precipitation_mm"),
        F.col("relative_humidity_2m").alias("humidity_%"))
    return hours.join(coordinates.select("station_id", "latitude", "longitude"), "station_id", "left")


def rejected_replies(replies: DataFrame) -> DataFrame:
    """Failed replies, reported instead of silently dropped."""
    why = F.coalesce("reason", F.when(F.col("unreadable").isNotNull(), F.lit("unreadable body")), F.lit("no hourly data"))
    return replies.filter(~accepted(replies)).select("station_id", "start_date", "status", why.alias("reason"))


def stations_without_reply(coordinates: DataFrame, replies: DataFrame) -> DataFrame:
    """Stations of which no reply could be used, with the number of failed ones."""
    good = replies.filter(accepted(replies)).select("station_id")
    failed = replies.filter(~accepted(replies)).groupBy("station_id").agg(F.count(F.lit(1)).alias("n_failed"))
    return (coordinates.join(good, "station_id", "left_anti").join(failed, "station_id", "left")
            .withColumn("n_failed", F.coalesce("n_failed", F.lit(0))))


# --- enrichment (J8, C1) -------------------------------------------------------------

def micro_degrees(c: str) -> Column:
    """A coordinate as a whole number of millionths of a degree: digits after the sixth place do not count."""
    return F.round(F.col(c).cast("double") * MICRO_DEGREES).cast("long")


def _keyed(df: DataFrame, hour: str) -> DataFrame:
    return df.withColumns({"_lat": micro_degrees("latitude"), "_lon": micro_degrees("longitude"), "_hour": F.col(hour)})


def enrich(rides_ts: DataFrame, weather_typed: DataFrame) -> DataFrame:
    """Left join the fact rows to hourly weather on coordinates and hour.

    Coordinates are compared in millionths of a degree.  Unmatched rides keep
    null measures.  The weather table has stations x hours rows, which grows
    with the span of the data, so no static broadcast hint: AQE broadcasts it
    only when its measured size is under the adaptive threshold, else the join
    is a shuffle join on (coordinates, hour), a key that spreads a busy
    station over all of its hours.
    """
    keys = ["_lat", "_lon", "_hour"]
    weather = _keyed(weather_typed, "weather_ts").select(*keys, *[F.col(f"`{c}`") for c in WEATHER_MEASURES])
    return _keyed(rides_ts, "ts").join(weather, keys, "left").drop(*keys, "Georeference")


def enrich_from_files(rides_ts: DataFrame, weather_paths) -> DataFrame:
    """J8 as a user runs it: ridership rows + yearly weather CSV files -> enriched rows.

    The weather files are read in one scan (union of years), typed, and
    left-joined on coordinates and hour.
    """
    return enrich(rides_ts, typed_weather(read_weather_csv(rides_ts.sparkSession, weather_paths)))
