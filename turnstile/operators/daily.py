"""Daily and per-station aggregates, filtered series, chart and map feeds
(D3-D5, D7, D10, D13, B9-B12, B15, B17, E4, F2, F3, H21, H23, H24, J1-J5).

The dashboard's pandas steps (filter, group, sort on the collected daily
table) stay in Catalyst here; a result that is collected is at most one row
per station and day.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstile.functions import numeric
from turnstile.functions.text import chart_file_name, ridership_label, series_title
from turnstile.functions.timefmt import format_day

ALL = "All"
DAILY_KEYS = ["station_complex", "borough", "fare_class_category", "payment_method", "year", "date"]


def daily_ridership(rides_ts: DataFrame) -> DataFrame:
    """Daily total by station, borough, fare class, payment method, year, date (D3).

    Partial aggregation per task, one shuffle on the six keys; the key count is
    stations x days x fare classes x payment methods, not rows.
    """
    return (rides_ts.groupBy("station_complex", "borough", "fare_class_category", "payment_method",
                             F.year("ts").alias("year"), F.to_date("ts").alias("date"))
            .agg(F.sum("ridership").cast("long").alias("daily_ridership")))


def station_map(rides: DataFrame) -> DataFrame:
    """Station total with coordinates and a popup label."""
    totals = (rides.groupBy("station_complex", "borough", "latitude", "longitude")
              .agg(F.sum("ridership").cast("long").alias("total_ridership")))
    return totals.withColumn("label", ridership_label("station_complex", "total_ridership"))


def _month_ok(month: int | None) -> None:
    if month is not None and not 1 <= month <= 12:
        raise ValueError(f"month {month} is not one of 1..12")


def series_predicate(ts: Column, year: int, fare_category: str | None = ALL, payment_method: str | None = ALL,
                     month: int | None = None, year_col: Column | None = None, month_col: Column | None = None) -> Column:
    """Conjunctive filter (B9) with optional parts: "All" / None skips a condition.

    ``year_col`` and ``month_col`` name partition columns that hold the same
    values, so that only the folders asked for are read.
    """
    _month_ok(month)
    conds = [(F.year(ts) if year_col is None else year_col) == F.lit(year)]
    if fare_category not in (None, ALL):
        conds.append(F.col("fare_class_category") == F.lit(fare_category))
    if payment_method not in (None, ALL):
        conds.append(F.col("payment_method") == F.lit(payment_method))
    if month is not None:
        conds.append((F.month(ts) if month_col is None else month_col) == F.lit(month))
    pred = conds[0]
    for c in conds[1:]:
        pred = pred & c
    return pred


def station_match(identifier: str) -> Column:
    """Station given by name or by id."""
    return (F.col("station_complex") == F.lit(identifier)) | (F.col("station_complex_id") == F.lit(identifier))


def station_series(rides_ts: DataFrame, year: int, fare_category: str = ALL, payment_method: str = ALL,
                   month: int | None = None, station: str | None = None, stations: DataFrame | None = None) -> DataFrame:
    """Daily series per station from the fact rows.

    ``station=None`` gives every station.  Result: station_complex, date (text
    ``yyyy-MM-dd``), total_ridership, ordered by station and date.  Over the
    typed sink (``files.write_typed``) the year and month prune folders;
    ``stations`` (id and name of every station) spares a scan to look an id up.
    """
    year_col, month_col = (F.col(c) if c in rides_ts.columns else None for c in ("year", "month"))
    df = rides_ts.filter(series_predicate(F.col("ts"), year, fare_category, payment_method, month, year_col, month_col))
    if station is not None:
        # an id stands for its whole station, which may have several ids
        known = rides_ts if stations is None else stations
        names = known.filter(station_match(station)).select("station_complex").distinct()
        df = df.join(names, "station_complex", "left_semi")
    per_day = df.groupBy("station_complex", F.to_date("ts").alias("date")).agg(F.sum("ridership").cast("long").alias("total_ridership"))
    return per_day.withColumn("date", format_day("date")).orderBy("station_complex", "date")


def series_from_daily(daily: DataFrame, station: str, year: int, fare_category: str = ALL,
                      payment_method: str = ALL, month: int | None = None) -> DataFrame:
    """One station's daily series over the daily pre-aggregate.

    The year and month are asked for as a range of dates, which prunes the
    folders of the stored table (``daily_table``).
    """
    _month_ok(month)
    first = dt.date(year, month or 1, 1)
    end = dt.date(year + 1, 1, 1) if month in (None, 12) else dt.date(year, month + 1, 1)
    conds = (F.col("station_complex") == F.lit(station)) & (F.col("date") >= F.lit(first)) & (F.col("date") < F.lit(end))
    if fare_category not in (None, ALL):
        conds = conds & (F.col("fare_class_category") == F.lit(fare_category))
    if payment_method not in (None, ALL):
        conds = conds & (F.col("payment_method") == F.lit(payment_method))
    per_day = daily.filter(conds).groupBy("station_complex", "date").agg(F.sum("daily_ridership").cast("long").alias("total_ridership"))
    return per_day.withColumn("date", format_day("date")).orderBy("date")


def chart_frame(series: DataFrame) -> DataFrame:
    """Per-point chart attributes.

    Windows run over the series (one row per station and day), partitioned by
    station: a group is at most the days in the filter, never the fact rows.
    """
    w_all = Window.partitionBy("station_complex")
    w_ord = w_all.orderBy("date")
    return (series
            .withColumn("n_points", F.count(F.lit(1)).over(w_all))
            .withColumn("max_ridership", F.max("total_ridership").over(w_all))
            .withColumn("rn", F.row_number().over(w_ord))
            .withColumn("y_step", numeric.axis_step(F.col("max_ridership")))
            .withColumn("x_tick", ((F.col("rn") - 1) % numeric.x_tick_every(F.col("n_points"))) == 0))


def chart_titles(series: DataFrame, year: int, fare_category: str, payment_method: str,
                 month: int | None = None) -> DataFrame:
    """Title and file name of each station's chart (H11, H20, H21): one row per station."""
    _month_ok(month)
    mname = (F.date_format(F.make_date(F.lit(year), F.lit(month), F.lit(1)), "MMMM") if month is not None
             else F.lit(None).cast("string"))
    per_station = series.groupBy("station_complex").agg(F.count(F.lit(1)).cast("long").alias("n_days"))
    return per_station.select(
        "station_complex", "n_days",
        series_title(F.col("station_complex"), F.lit(fare_category), F.lit(payment_method), mname, F.lit(year)).alias("title"),
        chart_file_name(F.col("station_complex"), F.lit(year), mname).alias("file_name"))


def y_ticks(series: DataFrame) -> DataFrame:
    """One row per y-axis tick per station."""
    per_station = (series.groupBy("station_complex")
                   .agg(F.max("total_ridership").alias("max_ridership")))
    return (per_station.withColumn("y_step", numeric.axis_step(F.col("max_ridership")))
            .select("station_complex", "max_ridership", "y_step",
                    F.posexplode(numeric.axis_ticks(F.col("max_ridership"), F.col("y_step"))).alias("tick_index", "tick")))


def x_ticks(series: DataFrame) -> DataFrame:
    """The dates that carry an x-axis label: every max(1, n // 5)-th point."""
    return chart_frame(series).filter("x_tick").select("station_complex", "date", "total_ridership", "rn")


SELECTOR_GROUPS = {
    "station": ["borough", "station_complex"],
    "borough": ["borough"],
    "fare_class": ["fare_class_category"],
    "payment_method": ["payment_method"],
    "year": ["year"],
}


def selector_domains(rides_ts: DataFrame) -> DataFrame:
    """Every selector domain in one scan.

    ``GROUPING SETS`` replaces one distinct job per domain: rows
    (domain, borough, value), stations carry their borough.
    """
    cols = ["borough", "station_complex", "fare_class_category", "payment_method", "year"]
    sets = [[F.col(c) for c in g] for g in SELECTOR_GROUPS.values()]
    # combinations first: the grouping sets then expand those and not the fact rows
    g = rides_ts.select(*cols).distinct().groupingSets(sets, *cols).agg(
        *[F.grouping(c).alias(f"g_{c}") for c in cols])
    domain = (F.when(F.col("g_station_complex") == 0, F.lit("station"))
              .when(F.col("g_borough") == 0, F.lit("borough"))
              .when(F.col("g_fare_class_category") == 0, F.lit("fare_class"))
              .when(F.col("g_payment_method") == 0, F.lit("payment_method"))
              .otherwise(F.lit("year")))
    value = (F.when(F.col("g_station_complex") == 0, F.col("station_complex"))
             .when(F.col("g_borough") == 0, F.col("borough"))
             .when(F.col("g_fare_class_category") == 0, F.col("fare_class_category"))
             .when(F.col("g_payment_method") == 0, F.col("payment_method"))
             .otherwise(F.col("year").cast("string")))
    return g.select(domain.alias("domain"),
                    F.when(F.col("g_station_complex") == 0, F.col("borough")).alias("borough"),
                    value.alias("value"))


def distinct_years(rides_ts: DataFrame) -> DataFrame:
    """Distinct non-null years, sorted."""
    return rides_ts.select(F.year("ts").alias("year")).filter(F.col("year").isNotNull()).distinct().orderBy("year")


def stations_in(domains: DataFrame, borough: str = ALL) -> DataFrame:
    """Stations of one borough, or of all (B15) from the selector domains."""
    s = domains.filter(F.col("domain") == "station")
    return (s if borough == ALL else s.filter(F.col("borough") == F.lit(borough))).select("value")


def is_empty(df: DataFrame) -> bool:
    """Empty-result guard (B17): one row is enough to decide."""
    return df.isEmpty()
