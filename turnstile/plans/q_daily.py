"""Daily/station aggregates, series, chart and map feeds, selector domains."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstile.operators import daily, daily_table
from turnstile.operators.ranking import with_ts
from turnstile.plans.registry import query
from turnstile.plans.sqlparts import with_ctes
from turnstile.session import scratch_path
from turnstile.sources import files
from turnstile.sources.adapters import rides, typed_rides

# Parameters of the registered series queries.
SERIES_YEAR = 2024
SERIES_FARE = "OMNY - click & x"
SERIES_PAYMENT = "omny"
SERIES_MONTH = 1
SERIES_STATION_ID = "7"
ALL_SERIES_STATION = "Stop 3 (3)"
ALL_SERIES_PAYMENT = "metrocard"
CHART_YEAR = 1996
CHART_PAYMENT = "F"
NAMED_STATION = "NATION_7"


def _events(spark, sf_dir):
    return with_ts(rides(spark, sf_dir, "events"))


def _orders(spark, sf_dir):
    return with_ts(rides(spark, sf_dir, "orders"))


DAILY_SQL = """
SELECT station_complex, borough, fare_class_category, payment_method,
       CAST(year(ts) AS INTEGER) AS year, CAST(ts AS DATE) AS date,
       CAST(sum(ridership) AS BIGINT) AS daily_ridership
FROM ev
GROUP BY station_complex, borough, fare_class_category, payment_method, year(ts), CAST(ts AS DATE)"""


@query("daily_ridership", with_ctes(DAILY_SQL, "ev"))
def daily_ridership(spark, sf_dir):
    return daily.daily_ridership(_events(spark, sf_dir))


@query("station_totals_map", with_ctes("""
SELECT station_complex, borough, latitude, longitude, total_ridership,
       station_complex || ' (Ridership: ' || CAST(total_ridership AS VARCHAR) || ')' AS label
FROM (SELECT station_complex, borough, latitude, longitude, CAST(sum(ridership) AS BIGINT) AS total_ridership
      FROM rides_events GROUP BY station_complex, borough, latitude, longitude) t""", "rides_events"))
def station_totals_map(spark, sf_dir):
    return daily.station_map(rides(spark, sf_dir, "events"))


@query("station_daily_series", with_ctes(f"""
SELECT station_complex, strftime(ts, '%Y-%m-%d') AS date, CAST(sum(ridership) AS BIGINT) AS total_ridership
FROM ev
WHERE year(ts) = {SERIES_YEAR} AND fare_class_category = '{SERIES_FARE}' AND payment_method = '{SERIES_PAYMENT}'
  AND month(ts) = {SERIES_MONTH}
  AND (station_complex = '{SERIES_STATION_ID}' OR station_complex_id = '{SERIES_STATION_ID}')
GROUP BY station_complex, strftime(ts, '%Y-%m-%d')""", "ev"))
def station_daily_series(spark, sf_dir):
    """One station by id over the typed sink: the year and month prune folders."""
    typed, stations = typed_rides(spark, sf_dir, "events")
    return daily.station_series(typed, SERIES_YEAR, SERIES_FARE, SERIES_PAYMENT, SERIES_MONTH, SERIES_STATION_ID, stations)


@query("station_daily_series_by_name", with_ctes(f"""
SELECT station_complex, strftime(ts, '%Y-%m-%d') AS date, CAST(sum(ridership) AS BIGINT) AS total_ridership
FROM od WHERE year(ts) = {CHART_YEAR} AND station_complex = '{NAMED_STATION}'
GROUP BY station_complex, strftime(ts, '%Y-%m-%d')""", "od"))
def station_daily_series_by_name(spark, sf_dir):
    """One station by name, all fares and methods, over the typed sink."""
    typed, stations = typed_rides(spark, sf_dir, "orders")
    return daily.station_series(typed, CHART_YEAR, station=NAMED_STATION, stations=stations)


_DAILY: dict[tuple[str, str], str] = {}


def _daily_table(spark, sf_dir):
    """The stored daily table of the events view, written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _DAILY:
        path = scratch_path(spark, "daily")
        daily_table.write(typed_rides(spark, sf_dir, "events")[0], path)
        _DAILY[key] = path
    return daily_table.read(spark, _DAILY[key])


@query("daily_table_refresh", with_ctes(DAILY_SQL, "ev"))
def daily_table_refresh(spark, sf_dir):
    """A stored daily table without its last day and some late rows of the first one, then brought up to date (D3).

    Only the two changed days are recomputed, from the typed sink, and only
    their folders are overwritten; the result equals the full aggregate.
    """
    rides_ts, _ = typed_rides(spark, sf_dir, "events")
    first, last = rides_ts.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    day = F.to_date("ts")
    late = F.coalesce((day == F.lit(last)) | ((day == F.lit(first)) & (F.col("ride_id") % 5 == 0)), F.lit(False))
    sink, table = scratch_path(spark, "facts"), scratch_path(spark, "daily_kept")
    files.write_typed(rides_ts.filter(~late), sink)
    daily_table.write(files.read_typed(spark, sink), table)
    new = rides_ts.filter(late)
    files.write_typed(new, sink, mode="append")
    daily_table.refresh(files.read_typed(spark, sink), table, daily_table.changed_days(new))
    return daily_table.read(spark, table)


@query("station_daily_series_all", with_ctes(f"""
SELECT station_complex, strftime(date, '%Y-%m-%d') AS date, CAST(sum(daily_ridership) AS BIGINT) AS total_ridership
FROM daily
WHERE station_complex = '{ALL_SERIES_STATION}' AND year = {SERIES_YEAR} AND payment_method = '{ALL_SERIES_PAYMENT}'
GROUP BY station_complex, strftime(date, '%Y-%m-%d')""", "ev", more=f"daily AS ({DAILY_SQL})"))
def station_daily_series_all(spark, sf_dir):
    """One station over the stored daily table: the dates prune its folders."""
    d = _daily_table(spark, sf_dir)
    return daily.series_from_daily(d, ALL_SERIES_STATION, SERIES_YEAR, daily.ALL, ALL_SERIES_PAYMENT, None)


CHART_SERIES_SQL = f"""series AS (
  SELECT station_complex, strftime(ts, '%Y-%m-%d') AS date, CAST(sum(ridership) AS BIGINT) AS total_ridership
  FROM od WHERE year(ts) = {CHART_YEAR} AND payment_method = '{CHART_PAYMENT}'
  GROUP BY station_complex, strftime(ts, '%Y-%m-%d'))"""


def _chart_series(spark, sf_dir):
    return daily.station_series(typed_rides(spark, sf_dir, "orders")[0], CHART_YEAR, daily.ALL, CHART_PAYMENT)


@query("series_y_ticks", with_ctes("""
SELECT station_complex, max_ridership, y_step, CAST(i AS INTEGER) AS tick_index, i * y_step AS tick
FROM (SELECT station_complex, max_ridership,
             CASE WHEN max_ridership <= 0 THEN 1000.0
                  ELSE greatest(1000.0, round_even(max_ridership / 5, -3)) END AS y_step
      FROM (SELECT station_complex, max(total_ridership) AS max_ridership FROM series GROUP BY station_complex) m) s,
     range(0, CAST(ceil((max_ridership + y_step) / y_step) AS BIGINT)) t(i)""", "od", more=CHART_SERIES_SQL))
def series_y_ticks(spark, sf_dir):
    return daily.y_ticks(_chart_series(spark, sf_dir))


@query("series_x_ticks", with_ctes("""
SELECT station_complex, date, total_ridership, CAST(rn AS INTEGER) AS rn
FROM (SELECT *, row_number() OVER (PARTITION BY station_complex ORDER BY date) AS rn,
             count(*) OVER (PARTITION BY station_complex) AS n
      FROM series) s
WHERE (rn - 1) % greatest(1, CAST(floor(n / 5) AS BIGINT)) = 0""", "od", more=CHART_SERIES_SQL))
def series_x_ticks(spark, sf_dir):
    return daily.x_ticks(_chart_series(spark, sf_dir))


@query("selector_domains", with_ctes("""
SELECT DISTINCT 'station' AS domain, borough, station_complex AS value FROM od
UNION ALL SELECT DISTINCT 'borough', CAST(NULL AS VARCHAR), borough FROM od
UNION ALL SELECT DISTINCT 'fare_class', CAST(NULL AS VARCHAR), fare_class_category FROM od
UNION ALL SELECT DISTINCT 'payment_method', CAST(NULL AS VARCHAR), payment_method FROM od
UNION ALL SELECT DISTINCT 'year', CAST(NULL AS VARCHAR), CAST(year AS VARCHAR) FROM od""", "od"))
def selector_domains(spark, sf_dir):
    return daily.selector_domains(_orders(spark, sf_dir))


@query("borough_stations", with_ctes("""
SELECT DISTINCT station_complex AS value FROM od WHERE borough = 'ASIA'""", "od"))
def borough_stations(spark, sf_dir):
    """The stations offered once a borough is chosen."""
    return daily.stations_in(daily.selector_domains(_orders(spark, sf_dir)), "ASIA")


@query("series_with_rides", with_ctes(f"""
SELECT station, EXISTS (SELECT 1 FROM ev WHERE station_complex = station AND year(ts) = {SERIES_YEAR}) AS has_rides
FROM (VALUES ('{ALL_SERIES_STATION}'), ('Nowhere (0)')) s(station)""", "ev"))
def series_with_rides(spark, sf_dir):
    """Which stations have a chart to draw: the empty-result guard over the stored daily table."""
    table = _daily_table(spark, sf_dir)
    rows = [(s, not daily.is_empty(daily.series_from_daily(table, s, SERIES_YEAR))) for s in (ALL_SERIES_STATION, "Nowhere (0)")]
    return spark.createDataFrame(rows, "station string, has_rides boolean")


@query("year_domain", with_ctes("""
SELECT DISTINCT CAST(year(ts) AS INTEGER) AS year FROM od WHERE year(ts) IS NOT NULL""", "od"))
def year_domain(spark, sf_dir):
    return daily.distinct_years(_orders(spark, sf_dir))


@query("chart_titles", with_ctes(f"""
SELECT station_complex, CAST(count(*) AS BIGINT) AS n_days,
       'Daily Ridership at ' || station_complex || chr(10) || '{SERIES_FARE}, {SERIES_PAYMENT}, '
         || strftime(make_date({SERIES_YEAR}, {SERIES_MONTH}, 1), '%B') || ' {SERIES_YEAR}' AS title,
       replace(replace(station_complex, ' ', '_'), '/', '_') || '_{SERIES_YEAR}_'
         || lower(strftime(make_date({SERIES_YEAR}, {SERIES_MONTH}, 1), '%B')) || '_barchart.png' AS file_name
FROM (SELECT DISTINCT station_complex, strftime(ts, '%Y-%m-%d') AS date FROM ev
      WHERE year(ts) = {SERIES_YEAR} AND fare_class_category = '{SERIES_FARE}'
        AND payment_method = '{SERIES_PAYMENT}' AND month(ts) = {SERIES_MONTH}) s
GROUP BY station_complex""", "ev"))
def chart_titles(spark, sf_dir):
    """Every station's chart title and file name for one filter set (J1 over all stations)."""
    series = daily.station_series(typed_rides(spark, sf_dir, "events")[0], SERIES_YEAR, SERIES_FARE, SERIES_PAYMENT, SERIES_MONTH)
    return daily.chart_titles(series, SERIES_YEAR, SERIES_FARE, SERIES_PAYMENT, SERIES_MONTH)
