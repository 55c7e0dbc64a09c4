"""Source/sink round trips and the streaming daily aggregate.

Each query writes into a fresh folder under the shared checkpoint folder,
reads it back with a fixed schema, and computes on what it read.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile import fixtures
from turnstile.operators import daily, ranking, weather
from turnstile.plans.q_daily import DAILY_SQL
from turnstile.plans.q_ranking import PER_BOROUGH_K, RANK_YEARS, TOP_K
from turnstile.plans.registry import query
from turnstile.plans.sqlparts import with_ctes
from turnstile.session import scratch_path
from turnstile.sources import files
from turnstile.sources.adapters import rides
from turnstile.streaming import daily as streaming_daily

PRUNED_BOROUGHS = ["Borough 1", "Borough 3"]


@query("partitioned_scan_counts", with_ctes("""
SELECT transit_mode, borough, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(ridership) AS BIGINT) AS total_ridership
FROM rides_events WHERE borough IN ('Borough 1', 'Borough 3')
GROUP BY transit_mode, borough""", "rides_events"))
def partitioned_scan_counts(spark, sf_dir):
    """Write by (transit_mode, borough), read back with partition pruning."""
    path = scratch_path(spark, "rides_partitioned")
    files.write_partitioned(rides(spark, sf_dir, "events"), path)
    back = files.read_parquet(spark, path).filter(F.col("borough").isin(PRUNED_BOROUGHS))
    return (back.groupBy("transit_mode", "borough")
            .agg(F.count(F.lit(1)).cast("long").alias("n_rows"), F.sum("ridership").cast("long").alias("total_ridership")))


@query("csv_ingest_top_stations", with_ctes("""
SELECT station_complex, CAST(sum(ridership) AS BIGINT) AS total_ridership
FROM od WHERE year IN (1996, 1997)
GROUP BY station_complex
ORDER BY total_ridership DESC, station_complex
LIMIT 10""", "od"))
def csv_ingest_top_stations(spark, sf_dir):
    """Raw CSV with header -> fixed-schema scan -> ranking."""
    path = scratch_path(spark, "rides_csv")
    files.write_csv(rides(spark, sf_dir, "orders"), path)
    raw = files.read_ridership_csv(spark, path)
    return ranking.top_stations(ranking.in_years(ranking.with_ts(raw), RANK_YEARS), TOP_K)


@query("csv_published_layout", with_ctes("""
SELECT station_complex_id, station_complex, borough, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(sum(ridership) AS BIGINT) AS total_ridership, min(latitude) AS latitude, min(longitude) AS longitude,
       min(transit_timestamp) AS first_timestamp
FROM rides_events GROUP BY station_complex_id, station_complex, borough""", "rides_events"))
def csv_published_layout(spark, sf_dir):
    """Every row of a CSV in the published layout (other order, Georeference, no id) is read (A1)."""
    path = scratch_path(spark, "rides_published")
    files.write_csv(fixtures.published(rides(spark, sf_dir, "events")), path)
    back = files.read_ridership_csv(spark, path)
    return back.groupBy("station_complex_id", "station_complex", "borough").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("ridership").alias("total_ridership"), F.min("latitude").alias("latitude"),
        F.min("longitude").alias("longitude"), F.min("transit_timestamp").alias("first_timestamp"))


@query("csv_mixed_headers", with_ctes("""
SELECT station_complex, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(ridership) AS BIGINT) AS total_ridership,
       CAST(count(*) FILTER (WHERE ride_id % 3 <> 1) AS BIGINT) AS n_points, min(transit_timestamp) AS first_timestamp, max(longitude) AS longitude
FROM rides_events WHERE NOT (ride_id % 3 = 2 AND ride_id % 7 = 0) GROUP BY station_complex""", "rides_events"))
def csv_mixed_headers(spark, sf_dir):
    """Files of two layouts and malformed lines in one read: every good row is there under its own columns (A1)."""
    back = files.read_ridership_csv(spark, fixtures.land_mixed_csv(rides(spark, sf_dir, "events"), scratch_path(spark, "rides_mixed")))
    return back.groupBy("station_complex").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("ridership").alias("total_ridership"), F.count("Georeference").alias("n_points"),
        F.min("transit_timestamp").alias("first_timestamp"), F.max("longitude").alias("longitude"))


@query("csv_rejected_lines", with_ctes("""
SELECT 'broken' AS layout, CAST(count(*) AS BIGINT) AS n_lines, min(transit_timestamp) AS first_timestamp
FROM rides_events WHERE ride_id % 3 = 2 AND ride_id % 7 = 0""", "rides_events"))
def csv_rejected_lines(spark, sf_dir):
    """Malformed lines by the folder that they came from (A1)."""
    lines = files.rejected_csv_lines(spark, fixtures.land_mixed_csv(rides(spark, sf_dir, "events"), scratch_path(spark, "rides_mixed")))
    return lines.groupBy(F.regexp_extract("file", "layout=([a-z]+)", 1).alias("layout")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.min(F.substring_index("line", ",", 1)).alias("first_timestamp"))


EXPORT_SCHEMA = T.StructType([
    T.StructField("station_complex", T.StringType()),
    T.StructField("total_ridership", T.LongType()),
    T.StructField("rank", T.IntegerType()),
])


@query("ranking_csv_export", with_ctes("""
SELECT * FROM (
  SELECT borough, station_complex, total_ridership,
         CAST(row_number() OVER (PARTITION BY borough ORDER BY total_ridership DESC, station_complex) AS INTEGER) AS rank
  FROM (SELECT borough, station_complex, CAST(sum(ridership) AS BIGINT) AS total_ridership
        FROM od WHERE year IN (1996, 1997) GROUP BY borough, station_complex) t
) r WHERE rank <= 3""", "od"))
def ranking_csv_export(spark, sf_dir):
    """Per-borough top-k written as one CSV folder per borough, read back (A10)."""
    ranked = ranking.top_per_borough(ranking.in_years(ranking.with_ts(rides(spark, sf_dir, "orders")), RANK_YEARS),
                                     PER_BOROUGH_K)
    path = scratch_path(spark, "top_per_borough_csv")
    files.write_csv(ranked, path, by=["borough"])
    back = spark.read.schema(EXPORT_SCHEMA.add("borough", T.StringType())).option("header", True).csv(path)
    return back.select("borough", "station_complex", "total_ridership", "rank")


@query("weather_csv_round_trip", with_ctes("""
SELECT weather_ts, temperature_C, precipitation_mm, "humidity_%", station_id, latitude, longitude
FROM weather_typed""", "weather_typed"))
def weather_csv_round_trip(spark, sf_dir):
    """Weather text landed as one CSV folder per half-month, read back as one union scan."""
    w = fixtures.derive_weather(ranking.with_ts(rides(spark, sf_dir, "events")))
    period = F.concat(F.substring("time", 1, 7), F.when(F.substring("time", 9, 2).cast("int") <= 15, "a").otherwise("b"))
    base = scratch_path(spark, "weather_csv")
    files.write_csv(w.withColumn("period", period), base, by=["period"])
    back = files.read_weather_csv(spark, [f"{base}/period=*a", f"{base}/period=*b"])
    return weather.typed_weather(back).select("weather_ts", "temperature_C", "precipitation_mm", "`humidity_%`",
                                              "station_id", "latitude", "longitude")


@query("streaming_daily_ridership", with_ctes(DAILY_SQL, "ev"))
def streaming_daily_ridership(spark, sf_dir):
    """The daily aggregate kept by a Structured Streaming query over landed files."""
    landing, out, ckpt = (scratch_path(spark, n) for n in ("landing", "daily_stream_out", "daily_stream_ckpt"))
    fixtures.land_files(rides(spark, sf_dir, "events"), landing)
    streaming_daily.run_daily(spark, landing, out, ckpt, files_per_trigger=2)
    return spark.read.parquet(out).select(*daily.DAILY_KEYS, "daily_ridership")
