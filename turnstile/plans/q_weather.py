"""Weather derivation, landed replies, enrichment and the data-quality profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstile import fixtures
from turnstile.operators import profile, weather
from turnstile.operators.ranking import with_ts
from turnstile.plans.registry import query
from turnstile.plans.sqlparts import with_ctes
from turnstile.schemas import RIDE_COLUMNS, WEATHER_MEASURES
from turnstile.session import scratch_path
from turnstile.sources.adapters import rides

ENRICHED_COLUMNS = RIDE_COLUMNS + WEATHER_MEASURES
_ENRICHED_SQL_COLS = ", ".join(RIDE_COLUMNS) + ', temperature_C, precipitation_mm, "humidity_%"'


def events_ts(spark, sf_dir):
    return with_ts(rides(spark, sf_dir, "events"))


def weather_text(spark, sf_dir):
    return fixtures.derive_weather(events_ts(spark, sf_dir))


def enriched(spark, sf_dir):
    """Events rides left-joined to typed hourly weather (keeps ts and year)."""
    ev = events_ts(spark, sf_dir)
    return weather.enrich(ev, weather.typed_weather(fixtures.derive_weather(ev)))


@query("weather_observations", with_ctes("""
SELECT time, temperature_C, precipitation_mm, "humidity_%", station_id, latitude, longitude
FROM weather_text""", "weather_text"))
def weather_observations(spark, sf_dir):
    return weather_text(spark, sf_dir)


# Landed reply files by application and folder: the reply queries read one landing.
_LANDED: dict[tuple[str, str], tuple[str, str]] = {}


def landed(spark, sf_dir):
    """Replies read from their files, and the coordinates table that the requests were made from."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LANDED:
        replies, coordinates = scratch_path(spark, "replies"), scratch_path(spark, "coordinates")
        fixtures.land_replies(weather_text(spark, sf_dir), replies)
        weather.station_coordinates(rides(spark, sf_dir, "events")).write.parquet(coordinates)
        _LANDED[key] = replies, coordinates
    replies, coordinates = _LANDED[key]
    return weather.read_reply_files(spark, replies), spark.read.parquet(coordinates)


@query("weather_from_json", with_ctes("""
SELECT station_id, strftime(weather_ts, '%Y-%m-%dT%H:%M') AS time, temperature_C, precipitation_mm,
       "humidity_%", latitude, longitude
FROM weather_typed
WHERE (month(weather_ts) + station_id) % 11 <> 0""", "weather_typed"))
def weather_from_json(spark, sf_dir):
    """Landed reply files, flattened, with the coordinates of their stations."""
    return weather.flatten_replies(*landed(spark, sf_dir))


@query("weather_rejected_replies", with_ctes("""
SELECT DISTINCT station_id, strftime(date_trunc('month', weather_ts), '%Y-%m-%d') AS start_date, 500 AS status,
       'request limit exceeded' AS reason
FROM weather_typed
WHERE (month(weather_ts) + station_id) % 11 = 0""", "weather_typed"))
def weather_rejected_replies(spark, sf_dir):
    """Failed requests, with what their files say."""
    return weather.rejected_replies(landed(spark, sf_dir)[0])


@query("weather_stations_without_reply", with_ctes("""
SELECT k + 1 AS station_id, latitude, longitude,
       CAST((SELECT count(DISTINCT month(weather_ts)) FROM weather_typed w WHERE w.station_id = k + 1) AS BIGINT) AS n_failed
FROM (SELECT DISTINCT CAST(station_complex_id AS BIGINT) AS k, latitude, longitude FROM rides_events) s
WHERE NOT EXISTS (SELECT 1 FROM weather_typed w WHERE w.station_id = k + 1 AND (month(weather_ts) + w.station_id) % 11 <> 0)""",
    "weather_typed"))
def weather_stations_without_reply(spark, sf_dir):
    """Stations whose weather is still to be asked for again."""
    replies, coordinates = landed(spark, sf_dir)
    return weather.stations_without_reply(coordinates, replies)


@query("weather_reply_sides", with_ctes("""
SELECT CAST(count(*) AS BIGINT) AS n_replies, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS n_accepted,
       CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS n_rejected
FROM (SELECT DISTINCT station_id, month(weather_ts) AS m, (month(weather_ts) + station_id) % 11 <> 0 AS ok
      FROM weather_typed) x""", "weather_typed"))
def weather_reply_sides(spark, sf_dir):
    """Replies of unknown status: each is on exactly one side, by its body."""
    bare = landed(spark, sf_dir)[0].withColumn("status", F.lit(None).cast("int"))
    ok = weather.accepted(bare)
    return bare.agg(F.count(F.lit(1)).alias("n_replies"), F.count_if(ok).alias("n_accepted"), F.count_if(~ok).alias("n_rejected"))


@query("weather_enriched_near", with_ctes("""
SELECT ride_id, temperature_C, precipitation_mm, "humidity_%"
FROM ev LEFT JOIN (SELECT * REPLACE (latitude + 0.0000002 AS latitude, longitude - 0.0000003 AS longitude) FROM weather_typed) w
  ON CAST(round(ev.longitude * 1000000) AS BIGINT) = CAST(round(w.longitude * 1000000) AS BIGINT)
 AND CAST(round(ev.latitude * 1000000) AS BIGINT) = CAST(round(w.latitude * 1000000) AS BIGINT) AND ev.ts = w.weather_ts""",
    "ev", "weather_typed"))
def weather_enriched_near(spark, sf_dir):
    """Weather whose coordinates differ from the rides' after the sixth place is joined all the same."""
    ev = events_ts(spark, sf_dir)
    near = weather.typed_weather(weather_text(spark, sf_dir)).withColumns(
        {"latitude": F.col("latitude") + 0.0000002, "longitude": F.col("longitude") - 0.0000003})
    return weather.enrich(ev, near).select("ride_id", "temperature_C", "precipitation_mm", "`humidity_%`")


@query("weather_enriched", with_ctes(f"SELECT {_ENRICHED_SQL_COLS} FROM enriched", "enriched"))
def weather_enriched(spark, sf_dir):
    return enriched(spark, sf_dir).select(*[F.col(f"`{c}`") for c in ENRICHED_COLUMNS])


@query("null_counts", with_ctes("SELECT " + ", ".join(
    f'CAST(sum(CASE WHEN "{c}" IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS "{c}"' for c in ENRICHED_COLUMNS)
    + " FROM enriched", "enriched"))
def null_counts(spark, sf_dir):
    return profile.null_counts(enriched(spark, sf_dir).select(*[F.col(f"`{c}`") for c in ENRICHED_COLUMNS]))


@query("domain_profile", with_ctes("""
SELECT CAST(count(*) AS BIGINT) AS n_rows,
       CAST(count(*) FILTER (WHERE transit_timestamp IS NULL) AS BIGINT) AS n_null_timestamp,
       CAST(count(DISTINCT station_complex_id) AS BIGINT) AS n_station_ids,
       CAST(count(DISTINCT station_complex) AS BIGINT) AS n_stations,
       CAST(count(DISTINCT payment_method) AS BIGINT) AS n_payment_methods,
       CAST(count(DISTINCT fare_class_category) AS BIGINT) AS n_fare_classes,
       CAST(count(DISTINCT year(ts)) AS BIGINT) AS n_years,
       CAST(count(*) FILTER (WHERE temperature_C IS NULL) AS BIGINT) AS n_weather_missing
FROM enriched""", "enriched"))
def domain_profile(spark, sf_dir):
    return profile.domain_profile(enriched(spark, sf_dir))
