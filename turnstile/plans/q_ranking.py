"""Ranking and reduction queries (SURVEY 7.3: top_stations, top_stations_per_borough,
reduced_station_rows, reduction_counts)."""

from __future__ import annotations


from turnstile.operators import profile, ranking
from turnstile.plans.registry import query
from turnstile.plans.sqlparts import with_ctes
from turnstile.sources.adapters import rides

# Parameters of the registered ranking queries (the orders view spans 1995-2001).
RANK_YEARS = (1996, 1997)
TOP_K = 10
PER_BOROUGH_K = 3
REDUCTION_SETS = {
    "top10": ("global", 10, None),
    "top3_x3": ("borough", 3, ["AMERICA", "ASIA", "EUROPE"]),
    "top3_x4": ("borough", 3, ["AMERICA", "ASIA", "EUROPE", "AFRICA"]),
}


def _ranked_orders(spark, sf_dir):
    return ranking.in_years(ranking.with_ts(rides(spark, sf_dir, "orders")), RANK_YEARS)


@query("top_stations", with_ctes("""
SELECT station_complex, CAST(sum(ridership) AS BIGINT) AS total_ridership
FROM od WHERE year IN (1996, 1997)
GROUP BY station_complex
ORDER BY total_ridership DESC, station_complex
LIMIT 10""", "od"))
def top_stations(spark, sf_dir):
    return ranking.top_stations(_ranked_orders(spark, sf_dir), TOP_K)


@query("top_stations_per_borough", with_ctes("""
SELECT * FROM (
  SELECT borough, station_complex, total_ridership,
         CAST(row_number() OVER (PARTITION BY borough ORDER BY total_ridership DESC, station_complex) AS INTEGER) AS rank
  FROM (SELECT borough, station_complex, CAST(sum(ridership) AS BIGINT) AS total_ridership
        FROM od WHERE year IN (1996, 1997) GROUP BY borough, station_complex) t
) r WHERE rank <= 3""", "od"))
def top_stations_per_borough(spark, sf_dir):
    return ranking.top_per_borough(_ranked_orders(spark, sf_dir), PER_BOROUGH_K)


@query("reduced_station_rows", with_ctes("""
SELECT ride_id, transit_timestamp, transit_mode, station_complex_id, station_complex, borough,
       payment_method, fare_class_category, ridership, latitude, longitude
FROM od
WHERE year IN (1996, 1997)
  AND station_complex IN (
    SELECT station_complex FROM (
      SELECT station_complex, row_number() OVER (PARTITION BY borough ORDER BY total DESC, station_complex) AS rn
      FROM (SELECT borough, station_complex, sum(ridership) AS total FROM od
            WHERE year IN (1996, 1997) GROUP BY borough, station_complex) t) r
    WHERE rn <= 3)""", "od"))
def reduced_station_rows(spark, sf_dir):
    filtered = _ranked_orders(spark, sf_dir)
    chosen = ranking.top_per_borough(filtered, PER_BOROUGH_K)
    # No borough list: k per borough over an open set of boroughs, so AQE sizes it.
    return ranking.reduce_to_stations(filtered, chosen).drop("ts", "year")


@query("reduction_counts", with_ctes("""
SELECT set_name, CAST(count(*) AS BIGINT) AS n_stations, CAST(sum(n) AS BIGINT) AS n_rows
FROM per_station JOIN sets USING (station_complex)
GROUP BY set_name""", "od", more="""
totals AS (SELECT borough, station_complex, sum(ridership) AS total FROM od
             WHERE year IN (1996, 1997) GROUP BY borough, station_complex),
g AS (SELECT station_complex, sum(total) AS total FROM totals GROUP BY station_complex),
pb AS (SELECT borough, station_complex,
              row_number() OVER (PARTITION BY borough ORDER BY total DESC, station_complex) AS rn FROM totals),
sets AS (
  SELECT 'top10' AS set_name, station_complex FROM (SELECT station_complex FROM g ORDER BY total DESC, station_complex LIMIT 10) x
  UNION ALL SELECT 'top3_x3', station_complex FROM pb WHERE rn <= 3 AND borough IN ('AMERICA', 'ASIA', 'EUROPE')
  UNION ALL SELECT 'top3_x4', station_complex FROM pb WHERE rn <= 3 AND borough IN ('AMERICA', 'ASIA', 'EUROPE', 'AFRICA')),
per_station AS (SELECT station_complex, count(*) AS n FROM od WHERE year IN (1996, 1997) GROUP BY station_complex)"""))
def reduction_counts(spark, sf_dir):
    return ranking.reduction_counts(_ranked_orders(spark, sf_dir), REDUCTION_SETS)


@query("ride_preview", with_ctes("""
SELECT ride_id, transit_timestamp, station_complex, ridership FROM rides_events ORDER BY ride_id LIMIT 5""", "rides_events"))
def ride_preview(spark, sf_dir):
    """The first rows by id, as a reader looks at them."""
    r = rides(spark, sf_dir, "events").select("ride_id", "transit_timestamp", "station_complex", "ridership")
    return profile.preview(r.orderBy("ride_id"))
