"""Calendar, holiday, lag, weather-flag, outlier, one-hot and scaling queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.functions import numeric
from turnstile.functions.text import has_prefix
from turnstile.operators import stats, features
from turnstile.operators.ranking import with_ts
from turnstile.plans.q_weather import enriched
from turnstile.plans.registry import query
from turnstile.plans.sqlparts import feature_ctes, holiday_ctes, with_ctes
from turnstile.schemas import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from turnstile.sources.adapters import rides

ROUND = 6


def _orders(spark, sf_dir):
    return with_ts(rides(spark, sf_dir, "orders"))


def _events(spark, sf_dir):
    return with_ts(rides(spark, sf_dir, "events"))


# Feature tables by application and folder: written once, read by every query on them.
_FEATURES: dict[tuple[str, str], DataFrame] = {}


def feature_table(spark, sf_dir):
    """Features of the enriched events before scaling, outliers cut, label added."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FEATURES:
        _FEATURES[key] = features.feature_frame(enriched(spark, sf_dir), scale=False)
    return _FEATURES[key]


@query("holiday_calendar", with_ctes("SELECT date, name FROM holidays", "od", more=holiday_ctes("od")))
def holiday_calendar(spark, sf_dir):
    return features.holidays_for(_orders(spark, sf_dir))


@query("calendar_features", with_ctes("""
SELECT ride_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
       CAST(month(ts) AS INTEGER) AS month,
       CASE WHEN isodow(ts) IN (6, 7) THEN 1 ELSE 0 END AS is_weekend,
       CASE WHEN CAST(ts AS DATE) IN (SELECT date FROM holidays) THEN 1 ELSE 0 END AS is_holiday
FROM od""", "od", more=holiday_ctes("od")))
def calendar_features(spark, sf_dir):
    df = features.calendar_features(_orders(spark, sf_dir))
    return df.select("ride_id", "hour", "day_of_week", "month", "is_weekend", "is_holiday")


@query("calendar_features_past", with_ctes("""
SELECT ride_id, CAST(ts AS DATE) AS date, CASE WHEN CAST(ts AS DATE) IN (SELECT date FROM holidays) THEN 1 ELSE 0 END AS is_holiday,
       (SELECT min(name) FROM holidays h WHERE h.date = CAST(od_past.ts AS DATE)) AS holiday
FROM od_past""", "od_past", more=holiday_ctes("od_past")))
def calendar_features_past(spark, sf_dir):
    """The orders 27 years earlier, across the change of the holiday law: the rules of each year hold."""
    past = _orders(spark, sf_dir).select("ride_id", F.add_months(F.to_date("ts"), -27 * 12).cast("timestamp_ntz").alias("ts"))
    df = features.calendar_features(past).select("ride_id", F.to_date("ts").alias("date"), "is_holiday")
    names = features.holidays_for(past).groupBy("date").agg(F.min("name").alias("holiday"))
    return df.join(names, "date", "left").select("ride_id", "date", "is_holiday", "holiday")


@query("ridership_lags", with_ctes("""
SELECT ride_id, station_complex, ridership,
       lag(ridership, 1) OVER w AS ridership_lag1, lag(ridership, 24) OVER w AS ridership_lag24
FROM ev
WINDOW w AS (PARTITION BY station_complex ORDER BY ts, fare_class_category, payment_method, ride_id)""", "ev"))
def ridership_lags(spark, sf_dir):
    df = features.lag_features(_events(spark, sf_dir))
    return df.select("ride_id", "station_complex", "ridership", "ridership_lag1", "ridership_lag24")


@query("ridership_lags_orders", with_ctes("""
SELECT ride_id, station_complex, ridership,
       lag(ridership, 1) OVER w AS ridership_lag1, lag(ridership, 24) OVER w AS ridership_lag24
FROM od
WINDOW w AS (PARTITION BY station_complex ORDER BY ts, fare_class_category, payment_method, ride_id)""", "od"))
def ridership_lags_orders(spark, sf_dir):
    """Lags over the orders view: one row per order, many stations per day."""
    df = features.lag_features(_orders(spark, sf_dir))
    return df.select("ride_id", "station_complex", "ridership", "ridership_lag1", "ridership_lag24")


@query("weather_flags", with_ctes("""
SELECT ride_id, coalesce(temperature_C, 0) AS temperature_C, coalesce(precipitation_mm, 0) AS precipitation_mm,
       coalesce("humidity_%", 0) AS "humidity_%",
       CASE WHEN precipitation_mm > 10 THEN 1 ELSE 0 END AS heavy_rain,
       CASE WHEN temperature_C > 30 THEN 1 ELSE 0 END AS high_temp
FROM enriched""", "enriched"))
def weather_flags(spark, sf_dir):
    df = features.weather_flags(enriched(spark, sf_dir))
    return df.select("ride_id", "temperature_C", "precipitation_mm", "`humidity_%`", "heavy_rain", "high_temp")


@query("iqr_fences", with_ctes("""
SELECT q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper
FROM (SELECT CAST(quantile_cont(ridership, 0.25) AS DOUBLE) AS q1,
             CAST(quantile_cont(ridership, 0.75) AS DOUBLE) AS q3 FROM rides_events) q""", "rides_events"))
def iqr_fences(spark, sf_dir):
    return features.iqr_fences(rides(spark, sf_dir, "events"))


@query("outlier_filtered", with_ctes("""
SELECT ride_id, ridership FROM rides_events, (
  SELECT q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper
  FROM (SELECT quantile_cont(ridership, 0.25) AS q1, quantile_cont(ridership, 0.75) AS q3 FROM rides_events) q) f
WHERE NOT coalesce(ridership < lower OR ridership > upper, false)""", "rides_events"))
def outlier_filtered(spark, sf_dir):
    return features.drop_outliers(rides(spark, sf_dir, "events")).select("ride_id", "ridership")


_DICT_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", category, CAST(row_number() OVER (ORDER BY category) - 1 AS DOUBLE) AS category_index
     FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS category FROM rides_events WHERE {c} IS NOT NULL) d{i}"""
    for i, c in enumerate(CATEGORICAL_FEATURES))
_SLUG_SQL = "regexp_replace(replace(replace(\"column\" || '_' || category, ' ', '_'), '/', '_'), '[^A-Za-z0-9_]+', '_', 'g')"


@query("category_dictionary", with_ctes(f"""
SELECT "column", category, category_index, {_SLUG_SQL} AS feature_name FROM ({_DICT_SQL}) dd""", "rides_events"))
def category_dictionary(spark, sf_dir):
    return features.category_dictionary(rides(spark, sf_dir, "events"), CATEGORICAL_FEATURES)


@query("feature_name_counts", with_ctes(f"""
SELECT "column", CAST(count(*) AS BIGINT) AS n_features, min(feature_name) AS first_feature
FROM (SELECT "column", {_SLUG_SQL} AS feature_name FROM ({_DICT_SQL}) dd) n
WHERE feature_name LIKE 'station_complex\\_Stop%' ESCAPE '\\' OR feature_name LIKE 'fare\\_class\\_category\\_OMNY%' ESCAPE '\\'
GROUP BY "column\"""", "rides_events"))
def feature_name_counts(spark, sf_dir):
    """Feature names that begin with one of two prefixes, per column."""
    d = features.category_dictionary(rides(spark, sf_dir, "events"), CATEGORICAL_FEATURES)
    wanted = has_prefix("feature_name", "station_complex_Stop") | has_prefix("feature_name", "fare_class_category_OMNY")
    return d.filter(wanted).groupBy("column").agg(F.count(F.lit(1)).alias("n_features"), F.min("feature_name").alias("first_feature"))


@query("unique_columns", with_ctes("""
SELECT ride_id, station_complex, ridership, borough FROM rides_events""", "rides_events"))
def unique_columns(spark, sf_dir):
    """Of equally named columns the first is kept."""
    r = rides(spark, sf_dir, "events")
    doubled = r.select("ride_id", "station_complex", "ridership", F.lit(-1).alias("ride_id"), "borough", F.upper("borough").alias("borough"))
    return features.unique_columns(doubled)


@query("one_hot_columns", with_ctes("SELECT r.ride_id, " + ", ".join(
    f"d{i}.category_index AS {c}_index, d{i}.feature_name AS {c}_feature" for i, c in enumerate(CATEGORICAL_FEATURES))
    + " FROM rides_events r " + " ".join(
    f"""LEFT JOIN dict d{i} ON d{i}."column" = '{c}' AND d{i}.category = CAST(r.{c} AS VARCHAR)"""
    for i, c in enumerate(CATEGORICAL_FEATURES)),
    "rides_events", more=f"""dict AS (SELECT "column", category, category_index, {_SLUG_SQL} AS feature_name
                             FROM ({_DICT_SQL}) dd)"""))
def one_hot_columns(spark, sf_dir):
    r = rides(spark, sf_dir, "events")
    d = features.category_dictionary(r, CATEGORICAL_FEATURES)
    return features.one_hot_index(r, d, CATEGORICAL_FEATURES, ["ride_id"])


# Categories of the orders view whose columns SQL has to name.
_DENSE = ([("station_complex_id", str(k)) for k in range(25)] + [("payment_method", p) for p in "FOP"]
          + [("fare_class_category", p) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])


def _dense_name(column: str, category: str) -> str:
    return re.sub("[^A-Za-z0-9_]+", "_", re.sub("[ /]", "_", f"{column}_{category}"))


@query("one_hot_dense", with_ctes("SELECT ride_id, ridership, " + ", ".join(
    f"""CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS "{_dense_name(c, v)}" """ for c, v in _DENSE) + " FROM rides_orders", "rides_orders"))
def one_hot_dense(spark, sf_dir):
    """One 0/1 column per category found in the data."""
    cols = ["station_complex_id", "payment_method", "fare_class_category"]
    return features.one_hot_dense(rides(spark, sf_dir, "orders").select("ride_id", "ridership", *cols), cols)


def _rounded(cols):
    return [F.round(F.col(f"`{c}`").cast("double"), ROUND).alias(c) for c in cols]


_FEATURE_SQL_COLS = ", ".join(f'(round(CAST("{c}" AS DOUBLE), {ROUND}) + 0.0) AS "{c}"' for c in NUMERIC_FEATURES + ["label"])


@query("iqr_fences_orders", with_ctes("""
SELECT q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper
FROM (SELECT quantile_cont(CAST(ridership AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(ridership AS DOUBLE), 0.75) AS q3
      FROM rides_orders) s""", "rides_orders"))
def iqr_fences_orders(spark, sf_dir):
    """Exact fences of a column with nearly as many values as rows."""
    return features.iqr_fences(rides(spark, sf_dir, "orders"))


@query("scaled_features", with_ctes(f"SELECT ride_id, {_FEATURE_SQL_COLS} FROM feat_scaled", "enriched",
                                    more=feature_ctes("enriched")))
def scaled_features(spark, sf_dir):
    df = features.scale_columns(feature_table(spark, sf_dir))
    return df.select("ride_id", *_rounded(NUMERIC_FEATURES + ["label"]))


@query("target_summary", with_ctes(f"""
SELECT CAST(count(label) AS BIGINT) AS count, (round(avg(label), {ROUND}) + 0.0) AS mean,
       (round(stddev_samp(label), {ROUND}) + 0.0) AS std, (round(min(label), {ROUND}) + 0.0) AS min,
       (round(quantile_cont(label, 0.25), {ROUND}) + 0.0) AS q25, (round(quantile_cont(label, 0.5), {ROUND}) + 0.0) AS q50,
       (round(quantile_cont(label, 0.75), {ROUND}) + 0.0) AS q75, (round(max(label), {ROUND}) + 0.0) AS max,
       (round(avg(ridership), {ROUND}) + 0.0) AS mean_ridership
FROM feat_scaled""", "enriched", more=feature_ctes("enriched")))
def target_summary(spark, sf_dir):
    df = feature_table(spark, sf_dir)
    q = [F.lit(x).cast("double") for x in stats.exact_quantiles(df, "label", [0.25, 0.5, 0.75])]
    return df.agg(
        F.count("label").cast("long").alias("count"), F.round(F.avg("label"), ROUND).alias("mean"),
        F.round(F.stddev_samp("label"), ROUND).alias("std"), F.round(F.min("label"), ROUND).alias("min"),
        F.round(q[0], ROUND).alias("q25"), F.round(q[1], ROUND).alias("q50"), F.round(q[2], ROUND).alias("q75"),
        F.round(F.max("label"), ROUND).alias("max"), F.round(F.avg("ridership"), ROUND).alias("mean_ridership"))


@query("log_round_trip", with_ctes("""
SELECT ride_id, ridership, CAST(ceil(exp(ln(1 + ridership)) - 1 - 1e-9) AS BIGINT) AS restored
FROM rides_events""", "rides_events"))
def log_round_trip(spark, sf_dir):
    """expm1(log1p(x)) == x on the ridership column."""
    r = rides(spark, sf_dir, "events")
    return r.select("ride_id", "ridership",
                    F.ceil(numeric.from_log_target(numeric.log_target("ridership")) - F.lit(1e-9)).cast("long").alias("restored"))
