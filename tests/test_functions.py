"""Column-function edge cases (FIXTURES.md section 3)."""

import datetime as dt

from pyspark.sql import functions as F

from turnstile.functions import calendar, numeric, text, timefmt


def _one(spark, col, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_corner_times_parse_on_12_hour_clock(spark):
    vals = ["01/02/2023 12:00:00 AM", "01/02/2023 01:00:00 AM", "01/02/2023 12:00:00 PM", "01/02/2023 01:00:00 PM"]
    got = _one(spark, timefmt.parse_transit_ts("s"), [(v,) for v in vals], "s string")
    assert [g.hour for g in got] == [0, 1, 12, 13]


def test_24_hour_pattern_with_marker_is_not_used(spark):
    # The HH + a pattern loses 12 AM and the PM hours; we parse with hh.
    got = _one(spark, timefmt.try_parse_ntz("s", "MM/dd/yyyy HH:mm:ss a"),
               [("01/02/2023 01:00:00 PM",), ("01/02/2023 12:00:00 AM",)], "s string")
    assert got == [None, None]


def test_bad_text_feb_30_and_clock_change(spark):
    vals = ["not a time", "02/30/2024 01:00:00 AM", "03/10/2024 02:30:00 AM", "1/2/2024 01:00:00 PM",
            "02/29/2024 11:59:59 PM", "13/01/2024 01:00:00 AM"]
    fast = _one(spark, timefmt.parse_transit_ts("s"), [(v,) for v in vals], "s string")
    generic = _one(spark, timefmt.try_parse_ntz("s", "MM/dd/yyyy hh:mm:ss a"), [(v,) for v in vals], "s string")
    assert fast == generic
    assert fast[0] is None and fast[1] is None and fast[3] is None and fast[5] is None
    assert fast[2] == dt.datetime(2024, 3, 10, 2, 30)   # wall clock kept in a New York session
    assert fast[4] == dt.datetime(2024, 2, 29, 23, 59, 59)


def test_text_measure_coercion(spark):
    got = _one(spark, numeric.to_double("s"), [("n/a",), ("12.5",), (None,)], "s string")
    assert got == [None, 12.5, None]


def test_threshold_flags_are_strict(spark):
    df = spark.createDataFrame([(10.0, 30.0), (10.1, 30.1), (None, None)], "p double, t double")
    got = df.select(numeric.heavy_rain("p"), numeric.high_temp("t")).collect()
    assert [tuple(r) for r in got] == [(0, 0), (1, 1), (0, 0)]


def test_axis_step_and_ticks(spark):
    df = spark.createDataFrame([(0,), (-5,), (2500,), (12500,), (17500,), (4000,)], "m long")
    got = df.select("m", numeric.axis_step("m").alias("s")).select(
        "m", "s", numeric.axis_ticks("m", "s").alias("t")).collect()
    by = {r.m: (r.s, r.t) for r in got}
    assert by[0] == (1000.0, [0.0])
    assert by[-5] == (1000.0, [0.0])
    assert by[2500] == (1000.0, [0.0, 1000.0, 2000.0, 3000.0])
    assert by[12500][0] == 2000.0            # 2500 rounds half-even to 2000
    assert by[17500][0] == 4000.0            # 3500 rounds half-even to 4000
    assert by[4000][1][-1] == 4000.0         # arange(0, 5000, 1000) ends at 4000


def test_x_tick_every(spark):
    got = _one(spark, numeric.x_tick_every("n"), [(3,), (5,), (12,)], "n long")
    assert got == [1, 1, 2]


def test_slug_one_rule(spark):
    cats = ["OMNY - Seniors & Disability", "34 St-Penn Station (A,C,E)", "a/b c"]
    got = _one(spark, text.feature_name("fare_class_category", F.col("s")), [(c,) for c in cats], "s string")
    assert got == ["fare_class_category_OMNY___Seniors___Disability",
                   "fare_class_category_34_St_Penn_Station__A_C_E_",
                   "fare_class_category_a_b_c"]


def test_label_and_units(spark):
    df = spark.createDataFrame([("Stop 1", 42, 212.0, 1.0)], "s string, n long, f double, i double")
    r = df.select(text.ridership_label("s", "n"), numeric.fahrenheit_to_celsius("f"), numeric.inches_to_mm("i")).first()
    assert r[0] == "Stop 1 (Ridership: 42)" and abs(r[1] - 100.0) < 1e-12 and abs(r[2] - 25.4) < 1e-12


def test_month_names(spark):
    df = spark.createDataFrame([("March",), ("Nope",)], "m string")
    assert [r[0] for r in df.select(calendar.month_number("m")).collect()] == [3, None]


def test_holidays_actual_and_observed(spark):
    years = spark.createDataFrame([(2021,), (2022,), (2023,), (2024,)], "year int")
    hol = {(r.date, r.name) for r in calendar.holiday_table(years).collect()}
    dates = {d for d, _ in hol}
    assert (dt.date(2023, 1, 2), "New Year's Day (observed)") in hol       # Jan 1 2023 is a Sunday
    assert (dt.date(2021, 12, 31), "New Year's Day (observed)") in hol     # Jan 1 2022 is a Saturday
    assert dt.date(2024, 1, 15) in dates                                   # MLK: 3rd Monday
    assert dt.date(2024, 5, 27) in dates                                   # Memorial Day: last Monday
    assert dt.date(2024, 11, 28) in dates                                  # Thanksgiving: 4th Thursday
    assert dt.date(2024, 6, 19) in dates and dt.date(2021, 6, 18) in dates  # Juneteenth and its observed day
    assert dt.date(2024, 1, 6) not in dates                                # ordinary Saturday
    assert len([d for d in dates if d.year == 2024]) == 11


def test_day_of_week_monday_zero(spark):
    got = _one(spark, calendar.day_of_week("d"), [(dt.date(2024, 1, 1),), (dt.date(2024, 1, 7),)], "d date")
    assert got == [0, 6]


def test_holiday_expression_matches_holiday_table(spark):
    years = spark.range(1990, 2031).select(F.col("id").cast("int").alias("year"))
    table = {r.date for r in calendar.holiday_table(years).collect()}
    days = spark.range(0, (dt.date(2030, 12, 31) - dt.date(1990, 1, 1)).days + 1).select(
        F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    flagged = {r.d for r in days.filter(calendar.is_us_holiday("d") == 1).collect()}
    in_range = {d for d in table if dt.date(1990, 1, 1) <= d <= dt.date(2030, 12, 31)}
    assert flagged == in_range


def test_combine_date_time_and_prefix(spark):
    df = spark.createDataFrame([("2024-01-02", "08:30:00", "station_complex_A"),
                                ("2024-02-30", "08:30:00", "fare_class_category_B"),
                                ("2024-01-02", "25:00:00", None)], "d string, t string, c string")
    got = df.select(timefmt.combine_date_time("d", "t").alias("dt"), text.has_prefix("c", "station_complex_").alias("p")).collect()
    assert got[0].dt == dt.datetime(2024, 1, 2, 8, 30) and got[1].dt is None and got[2].dt is None
    assert [r.p for r in got] == [True, False, None]


def test_month_name_number_round_trip(spark):
    df = spark.createDataFrame([(dt.date(2024, m, 1),) for m in range(1, 13)], "d date")
    got = df.select(calendar.month_number(calendar.month_name("d")).alias("m")).collect()
    assert [r.m for r in got] == list(range(1, 13))


def test_holiday_rules_hold_in_their_years(spark):
    days = {dt.date(1965, 5, 30): 1, dt.date(1965, 5, 31): 1, dt.date(1975, 10, 27): 1, dt.date(1975, 11, 11): 0, dt.date(1970, 2, 22): 1,
            dt.date(1970, 2, 16): 0, dt.date(1971, 2, 15): 1, dt.date(1971, 2, 22): 0, dt.date(1971, 5, 31): 1, dt.date(1978, 11, 11): 1,
            dt.date(1977, 11, 11): 0, dt.date(1941, 11, 20): 1, dt.date(1941, 11, 27): 0, dt.date(1939, 11, 23): 1, dt.date(1938, 11, 24): 1,
            dt.date(1985, 1, 21): 0, dt.date(1986, 1, 20): 1, dt.date(1950, 11, 11): 1, dt.date(1970, 10, 12): 0, dt.date(1971, 10, 11): 1}
    df = spark.createDataFrame([(d,) for d in days], "d date")
    assert {r.d: r.h for r in df.select("d", calendar.is_us_holiday("d").alias("h")).collect()} == days


def test_holiday_expression_matches_holiday_table_in_the_past(spark):
    years = spark.range(1870, 1990).select(F.col("id").cast("int").alias("year"))
    table = {r.date for r in calendar.holiday_table(years).collect()}
    days = spark.range((dt.date(1989, 12, 30) - dt.date(1871, 1, 2)).days).select(
        F.date_add(F.lit("1871-01-02").cast("date"), F.col("id").cast("int")).alias("d"))
    flagged = {r.d for r in days.filter(calendar.is_us_holiday("d") == 1).collect()}
    assert flagged == {d for d in table if dt.date(1871, 1, 2) <= d < dt.date(1989, 12, 30)}
