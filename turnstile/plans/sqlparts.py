"""DuckDB SQL building blocks for the oracles: the same adapter views and
helpers as the Spark side, written independently in SQL."""

from __future__ import annotations

# Named common table expressions; ``with_ctes`` emits them in the order given.
CTES: dict[str, str] = {
    "rides_events": """
  SELECT event_id AS ride_id,
         strftime(date_trunc('hour', ts), '%m/%d/%Y %I:%M:%S %p') AS transit_timestamp,
         CASE WHEN user_id % 25 = 24 THEN 'tram' ELSE 'subway' END AS transit_mode,
         CAST(user_id % 25 AS VARCHAR) AS station_complex_id,
         'Stop ' || CAST(user_id % 25 AS VARCHAR) || ' (' || CAST(user_id % 25 % 7 AS VARCHAR) || ')' AS station_complex,
         'Borough ' || CAST(user_id % 25 % 5 AS VARCHAR) AS borough,
         CASE WHEN event_id % 2 = 0 THEN 'omny' ELSE 'metrocard' END AS payment_method,
         CASE WHEN event_id % 2 = 0 THEN 'OMNY - ' ELSE 'Metrocard - ' END || event_type || ' & x' AS fare_class_category,
         CAST(floor(value) AS BIGINT) AS ridership,
         CAST(4050 + user_id % 25 AS DOUBLE) / 100 AS latitude,
         CAST(-7400 + user_id % 25 AS DOUBLE) / 100 AS longitude
  FROM events""",
    "rides_orders": """
  SELECT o.o_orderkey AS ride_id,
         strftime(o.o_orderdate, '%m/%d/%Y %I:%M:%S %p') AS transit_timestamp,
         'subway' AS transit_mode,
         CAST(n.n_nationkey AS VARCHAR) AS station_complex_id,
         n.n_name AS station_complex,
         r.r_name AS borough,
         o.o_orderstatus AS payment_method,
         o.o_orderpriority AS fare_class_category,
         CAST(floor(o.o_totalprice) AS BIGINT) AS ridership,
         CAST(4050 + n.n_nationkey AS DOUBLE) / 100 AS latitude,
         CAST(-7400 + n.n_nationkey AS DOUBLE) / 100 AS longitude
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "ev": """
  SELECT *, strptime(transit_timestamp, '%m/%d/%Y %I:%M:%S %p') AS ts,
         CAST(year(strptime(transit_timestamp, '%m/%d/%Y %I:%M:%S %p')) AS INTEGER) AS year
  FROM rides_events""",
    "od_past": """
  SELECT ride_id, CAST(CAST(ts AS DATE) - INTERVAL 27 YEAR AS TIMESTAMP) AS ts FROM od""",
    "od": """
  SELECT *, strptime(transit_timestamp, '%m/%d/%Y %I:%M:%S %p') AS ts,
         CAST(year(strptime(transit_timestamp, '%m/%d/%Y %I:%M:%S %p')) AS INTEGER) AS year
  FROM rides_orders""",
}

# Dependencies between the named CTEs (each lists what it reads).
DEPS: dict[str, list[str]] = {
    "ev": ["rides_events"],
    "od": ["rides_orders"],
    "od_past": ["od"],
}


def _expand(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        for d in DEPS.get(n, []):
            visit(d)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def with_ctes(body: str, *names: str, more: str = "") -> str:
    """``WITH <named ctes>[, <more>] <body>``; ``more`` holds query-local CTEs."""
    parts = [f"{n} AS ({CTES[n]}\n)" for n in _expand(list(names))]
    if more.strip():
        parts.append(more.strip())
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def register(name: str, sql: str, deps: list[str] | None = None) -> None:
    CTES[name] = sql
    if deps:
        DEPS[name] = deps


# --- derived weather (same formula as operators/weather.py) ---------------------------
register("weather_text", """
  SELECT strftime(t, '%Y-%m-%dT%H:%M') AS time,
         CASE WHEN (h * 7 + k) % 97 = 0 THEN 'n/a' ELSE CAST((h * 7 + k * 3) % 45 - 8 AS VARCHAR) END AS temperature_C,
         CAST((h * 5 + k) % 13 AS VARCHAR) AS precipitation_mm,
         CAST(30 + (h * 3 + k) % 70 AS VARCHAR) AS "humidity_%",
         k + 1 AS station_id, latitude, longitude
  FROM (
    SELECT k, latitude, longitude, t,
           date_diff('day', DATE '2024-01-01', CAST(t AS DATE)) * 24 + hour(t) AS h
    FROM (
      SELECT CAST(station_complex_id AS BIGINT) AS k, latitude, longitude,
             CAST(first_day AS TIMESTAMP) + i * INTERVAL 1 HOUR AS t
      FROM (SELECT station_complex_id, latitude, longitude, first_day,
                   unnest(range(0, (date_diff('day', first_day, last_day) + 1) * 24)) AS i
            FROM (SELECT station_complex_id, latitude, longitude,
                         min(CAST(ts AS DATE)) AS first_day, max(CAST(ts AS DATE)) AS last_day
                  FROM ev GROUP BY station_complex_id, latitude, longitude) g) sd
    ) hrs
  ) hh
  WHERE (h + k) % 10 <> 0""", ["ev"])

register("weather_typed", """
  SELECT strptime(time, '%Y-%m-%dT%H:%M') AS weather_ts,
         TRY_CAST(temperature_C AS DOUBLE) AS temperature_C,
         TRY_CAST(precipitation_mm AS DOUBLE) AS precipitation_mm,
         TRY_CAST("humidity_%" AS DOUBLE) AS "humidity_%",
         CAST(station_id AS BIGINT) AS station_id, latitude, longitude
  FROM weather_text""", ["weather_text"])

register("enriched", """
  SELECT ev.*, w.temperature_C, w.precipitation_mm, w."humidity_%"
  FROM ev LEFT JOIN weather_typed w
    ON ev.longitude = w.longitude AND ev.latitude = w.latitude AND ev.ts = w.weather_ts""", ["ev", "weather_typed"])


# --- holidays (written down apart from functions/calendar.py) -----------------------------
# Name, month, day of month, ISO weekday (Monday 1), its place in the month (9 = last), first and last year.
_HOLIDAY_RULES = """
    ('New Year''s Day', 1, 1, NULL, NULL, 1871, 9999), ('Independence Day', 7, 4, NULL, NULL, 1871, 9999),
    ('Christmas Day', 12, 25, NULL, NULL, 1871, 9999), ('Juneteenth National Independence Day', 6, 19, NULL, NULL, 2021, 9999),
    ('Armistice Day', 11, 11, NULL, NULL, 1938, 1953), ('Veterans Day', 11, 11, NULL, NULL, 1954, 1970),
    ('Veterans Day', 11, 11, NULL, NULL, 1978, 9999), ('Veterans Day', 10, NULL, 1, 4, 1971, 1977),
    ('Memorial Day', 5, 30, NULL, NULL, 1888, 1970), ('Memorial Day', 5, NULL, 1, 9, 1971, 9999),
    ('Washington''s Birthday', 2, 22, NULL, NULL, 1880, 1970), ('Washington''s Birthday', 2, NULL, 1, 3, 1971, 9999),
    ('Martin Luther King Jr. Day', 1, NULL, 1, 3, 1986, 9999), ('Labor Day', 9, NULL, 1, 1, 1894, 9999),
    ('Columbus Day', 10, NULL, 1, 2, 1971, 9999), ('Thanksgiving', 11, NULL, 4, 4, 1942, 9999),
    ('Thanksgiving', 11, NULL, 4, 3, 1940, 1941), ('Thanksgiving', 11, NULL, 4, 4, 1939, 1939),
    ('Thanksgiving', 11, NULL, 4, 9, 1871, 1938)"""


def holiday_ctes(source: str) -> str:
    """``years``, ``holiday_rules``, ``holiday_actual``, ``holidays`` over the years of ``source``."""
    return f"""years AS (
  SELECT unnest(range(min(year(ts)) - 1, max(year(ts)) + 2)) AS y FROM {source}),
holiday_rules AS (
  SELECT name, month, day, iso - 1 AS wd, CASE WHEN nth = 9 THEN -1 ELSE nth END AS nth, first_year, last_year
  FROM (VALUES {_HOLIDAY_RULES}) r(name, month, day, iso, nth, first_year, last_year)),
holiday_actual AS (
  SELECT name, day IS NOT NULL AS fixed,
         CASE WHEN day IS NOT NULL THEN make_date(y, month, day)
              WHEN nth = -1 THEN CAST(last_day(make_date(y, month, 1)) - CAST((isodow(last_day(make_date(y, month, 1))) - 1 - wd + 7) % 7 AS INTEGER) AS DATE)
              ELSE CAST(make_date(y, month, 1) + CAST((wd - (isodow(make_date(y, month, 1)) - 1) + 7) % 7 + (nth - 1) * 7 AS INTEGER) AS DATE)
         END AS date
  FROM years JOIN holiday_rules ON y BETWEEN first_year AND last_year),
holidays AS (
  SELECT date, name FROM holiday_actual
  UNION ALL
  SELECT CAST(CASE WHEN isodow(date) = 6 THEN date - 1 ELSE date + 1 END AS DATE) AS date, name || ' (observed)' AS name
  FROM holiday_actual WHERE fixed AND isodow(date) IN (6, 7))"""


def feature_ctes(source: str = "enriched") -> str:
    """Calendar, lags, flags, fill, IQR cut and scaling over ``source`` (with holidays of it)."""
    scaled = ",\n         ".join(
        f'(CAST("{c}" AS DOUBLE) - m_{i}) / CASE WHEN s_{i} = 0 THEN 1 ELSE s_{i} END AS "{c}"'
        for i, c in enumerate(SCALED))
    stats = ", ".join(f'avg("{c}") AS m_{i}, stddev_pop("{c}") AS s_{i}' for i, c in enumerate(SCALED))
    return holiday_ctes(source) + f""",
feat_cal AS (
  SELECT s.*, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
         CAST(month(ts) AS INTEGER) AS month,
         CASE WHEN isodow(ts) IN (6, 7) THEN 1 ELSE 0 END AS is_weekend,
         CASE WHEN CAST(ts AS DATE) IN (SELECT date FROM holidays) THEN 1 ELSE 0 END AS is_holiday,
         lag(ridership, 1) OVER w AS lag1_raw, lag(ridership, 24) OVER w AS lag24_raw
  FROM {source} s
  WINDOW w AS (PARTITION BY station_complex ORDER BY ts ASC NULLS FIRST, fare_class_category ASC NULLS FIRST,
               payment_method ASC NULLS FIRST, ride_id ASC NULLS FIRST)),
feat_filled AS (
  SELECT * EXCLUDE (lag1_raw, lag24_raw, temperature_C, precipitation_mm, "humidity_%"),
         coalesce(lag1_raw, 0) AS ridership_lag1, coalesce(lag24_raw, 0) AS ridership_lag24,
         CASE WHEN precipitation_mm > 10 THEN 1 ELSE 0 END AS heavy_rain,
         CASE WHEN temperature_C > 30 THEN 1 ELSE 0 END AS high_temp,
         coalesce(temperature_C, 0) AS temperature_C, coalesce(precipitation_mm, 0) AS precipitation_mm,
         coalesce("humidity_%", 0) AS "humidity_%"
  FROM feat_cal),
fences AS (
  SELECT q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper
  FROM (SELECT CAST(quantile_cont(ridership, 0.25) AS DOUBLE) AS q1,
               CAST(quantile_cont(ridership, 0.75) AS DOUBLE) AS q3 FROM feat_filled) q),
feat_kept AS (
  SELECT f.* FROM feat_filled f, fences
  WHERE NOT coalesce(ridership < lower OR ridership > upper, false)),
feat_stats AS (SELECT {stats} FROM feat_kept),
feat_scaled AS (
  SELECT k.* EXCLUDE ({", ".join('"' + c + '"' for c in SCALED)}),
         {scaled},
         ln(1 + ridership) AS label
  FROM feat_kept k, feat_stats)"""


SCALED = ["hour", "day_of_week", "month", "ridership_lag1", "ridership_lag24",
          "temperature_C", "humidity_%", "precipitation_mm"]
