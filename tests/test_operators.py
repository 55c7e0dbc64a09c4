"""Operator edge cases on hand-written rows (FIXTURES.md section 3)."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from turnstile.operators import daily, features, ranking, requests, weather
from turnstile.schemas import RAW_RIDES

FARES = ["OMNY - Full Fare", "Metrocard - Full Fare"]


def _rides(spark, rows):
    """rows: (ride_id, 'MM/dd/yyyy hh:mm:ss a', station, borough, fare, payment, ridership)."""
    full = [(rid, ts, "subway", str(abs(hash(st)) % 1000), st, b, pay, fare, n, 40.5, -74.0)
            for rid, ts, st, b, fare, pay, n in rows]
    return spark.createDataFrame(full, RAW_RIDES)


def _ts(h, day=2):
    t = dt.datetime(2024, 1, day, 0) + dt.timedelta(hours=h)
    return t.strftime("%m/%d/%Y %I:%M:%S %p")


def test_lag_is_rows_back_with_several_fares_per_hour(spark):
    rows = []
    rid = 0
    for h in range(30):
        for fare in FARES:                      # two rows per hour: lag 24 is 12 hours back
            rows.append((rid, _ts(h), "A", "X", fare, "omny", rid)); rid += 1
    rows += [(1000 + i, _ts(i), "B", "X", FARES[0], "omny", i) for i in range(3)]   # fewer than 24 rows
    df = ranking.with_ts(_rides(spark, rows))
    got = {r.ride_id: (r.ridership_lag1, r.ridership_lag24) for r in features.lag_features(df).collect()}
    # order within an hour is by fare name: "Metrocard..." < "OMNY..."
    assert got[1000] == (None, None) and got[1002] == (1001 - 1000, None)
    a = sorted((r for r in rows if r[2] == "A"), key=lambda r: (r[1][6:10], r[1], r[4]))
    w = Window.partitionBy("station_complex").orderBy("ts", "fare_class_category", "payment_method", "ride_id")
    plain = {r.ride_id: (r.l1, r.l24) for r in df.select(
        "ride_id", F.lag("ridership", 1).over(w).alias("l1"), F.lag("ridership", 24).over(w).alias("l24")).collect()}
    assert got == plain
    assert len(a) == 60


@pytest.mark.parametrize("seed,n_rows,n_hours", [(1, 400, 24 * 5), (2, 60, 24 * 20), (3, 900, 24 * 2), (4, 200, 24 * 40)])
def test_edge_lag_equals_plain_window(spark, seed, n_rows, n_hours):
    # dense days (body + edge rows), sparse days (all rows are edges; lags reach back several days)
    rnd = random.Random(seed)
    rows = [(i, _ts(rnd.randrange(0, n_hours), day=1), rnd.choice(["A", "B", "C"]), "X", rnd.choice(FARES),
             rnd.choice(["omny", "metrocard"]), rnd.randrange(0, 500)) for i in range(n_rows)]
    rows.append((999, None, "A", "X", FARES[0], "omny", 7))            # null time sorts first
    rows.append((998, _ts(3), None, "X", FARES[0], "omny", 8))          # null station is its own group
    df = ranking.with_ts(_rides(spark, rows))
    w = Window.partitionBy("station_complex").orderBy("ts", "fare_class_category", "payment_method", "ride_id")
    plain = df.select("ride_id", F.lag("ridership", 1).over(w).alias("ridership_lag1"),
                      F.lag("ridership", 24).over(w).alias("ridership_lag24"))
    got = features.lag_features(df).select("ride_id", "ridership_lag1", "ridership_lag24")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_top_k_tie_broken_by_name(spark):
    rows = [(1, _ts(1), "B", "X", FARES[0], "omny", 10), (2, _ts(1), "A", "X", FARES[0], "omny", 10),
            (3, _ts(1), "C", "X", FARES[0], "omny", 5)]
    df = ranking.with_ts(_rides(spark, rows))
    assert [r.station_complex for r in ranking.top_stations(df, 2).collect()] == ["A", "B"]
    per = ranking.top_per_borough(df, 1).collect()
    assert [(r.station_complex, r.rank) for r in per] == [("A", 1)]


def test_iqr_fence_value_is_kept(spark):
    # q1 = 2, q3 = 4, iqr = 2 -> fences -1 and 7: 7 stays, 8 goes
    vals = [1, 2, 2, 3, 4, 4, 7] + [8]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "ride_id long, ridership long")
    f = features.iqr_fences(df).first()
    kept = {r.ridership for r in features.drop_outliers(df).collect()}
    assert 8 not in kept or f.upper >= 8
    assert all(f.lower <= v <= f.upper for v in kept)
    assert {v for v in vals if f.lower <= v <= f.upper} == kept


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    out = features.scale_columns(df, ["a", "b"]).collect()
    assert [r.b for r in out] == [0.0, 0.0] and sorted(r.a for r in out) == [-1.0, 1.0]


def test_ride_without_weather_keeps_nulls(spark):
    rows = [(1, _ts(1), "A", "X", FARES[0], "omny", 3)]
    df = ranking.with_ts(_rides(spark, rows))
    w = spark.createDataFrame([("2024-01-02T05:00", "1", "0", "50", "1", "40.5", "-74.0")],
                              "time string, temperature_C string, precipitation_mm string, `humidity_%` string, "
                              "station_id string, latitude string, longitude string")
    out = weather.enrich(df, weather.typed_weather(w)).collect()
    assert len(out) == 1 and out[0].temperature_C is None


def test_month_out_of_range_rejected(spark):
    with pytest.raises(ValueError):
        daily.series_predicate(F.col("ts"), 2024, month=13)
    with pytest.raises(ValueError):
        daily.series_predicate(F.col("ts"), 2024, month=0)


def test_station_by_id_or_name_same_series(spark):
    rows = [(1, _ts(1), "Alpha", "X", FARES[0], "omny", 3), (2, _ts(30), "Alpha", "X", FARES[0], "omny", 4),
            (3, _ts(1), "Beta", "X", FARES[0], "omny", 9)]
    df = ranking.with_ts(_rides(spark, rows))
    sid = df.filter("station_complex = 'Alpha'").first().station_complex_id
    by_name = daily.station_series(df, 2024, station="Alpha").collect()
    by_id = daily.station_series(df, 2024, station=sid).collect()
    assert by_name == by_id and [r.total_ridership for r in by_name] == [3, 4]


def test_all_skips_filter(spark):
    rows = [(1, _ts(1), "A", "X", FARES[0], "omny", 3), (2, _ts(1), "A", "X", FARES[1], "metrocard", 4)]
    d = daily.daily_ridership(ranking.with_ts(_rides(spark, rows)))
    assert daily.series_from_daily(d, "A", 2024).first().total_ridership == 7
    assert daily.series_from_daily(d, "A", 2024, payment_method="omny").first().total_ridership == 3


def test_request_rejections(spark):
    train = _rides(spark, [(1, _ts(1), "A", "X", FARES[0], "omny", 3)])
    req = spark.createDataFrame([
        (1, "A", "2024-01-02", "08:00:00", 70.0, 50.0, 0.1, FARES[0], "omny"),
        (2, "Z", "2024-01-02", "08:00:00", 70.0, 50.0, 0.1, FARES[0], "omny"),
        (3, "A", "2024-01-02", "08:00:00", 70.0, 50.0, 0.1, "Bus", "omny"),
        (4, "A", "2024-01-02", "08:00:00", 70.0, 50.0, 0.1, FARES[0], "cash"),
        (5, "A", "2024-02-30", "08:00:00", 70.0, 50.0, 0.1, FARES[0], "omny"),
        (6, "A", "2024-01-02", "08:00:00", 130.0, 50.0, 0.1, FARES[0], "omny"),
    ], "request_id long, station string, date string, time string, temp_f double, humidity double, "
       "precipitation_in double, fare_class string, payment_method string")
    got = {r.request_id: r.reject_reason for r in requests.validate(req, requests.domains(train)).collect()}
    assert got == {1: None, 2: "unknown station", 3: "unknown fare class", 4: "unknown payment method",
                   5: "invalid timestamp", 6: "temperature out of range"}


def test_lag_with_a_hot_station_holding_a_third_of_rows(spark):
    from conftest import SF_CHECK
    from turnstile.sources.adapters import rides
    r = ranking.with_ts(rides(spark, SF_CHECK, "events"))
    # one station takes a third of all rows
    hot = r.withColumn("station_complex", F.when(F.col("ride_id") % 3 == 0, F.lit("Hot")).otherwise(F.col("station_complex")))
    w = Window.partitionBy("station_complex").orderBy("ts", "fare_class_category", "payment_method", "ride_id")
    plain = hot.select("ride_id", F.lag("ridership", 1).over(w).alias("ridership_lag1"),
                       F.lag("ridership", 24).over(w).alias("ridership_lag24"))
    got = features.lag_features(hot).select("ride_id", "ridership_lag1", "ridership_lag24")
    assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_lags_over_many_ranges(spark, parts):
    """Ranges of a few rows, smaller than the longest lag, and stations that span many of them."""
    rnd = random.Random(parts)
    rows = [(i, _ts(rnd.randrange(0, 300), day=1), rnd.choice("AAAAAAB"), "X", rnd.choice(FARES), "omny", rnd.randrange(0, 500)) for i in range(300)]
    df = ranking.with_ts(_rides(spark, rows))
    w = Window.partitionBy("station_complex").orderBy("ts", "fare_class_category", "payment_method", "ride_id")
    plain = df.select("ride_id", F.lag("ridership", 1).over(w).alias("l1"), F.lag("ridership", 24).over(w).alias("l24"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = features.lag_features(df).select("ride_id", "ridership_lag1", "ridership_lag24").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, got)) == sorted(map(tuple, plain.collect()))


def test_value_exactly_on_upper_fence_is_kept(spark):
    # ten values: q1 = 0, q3 = 2 (linear interpolation), iqr = 2, upper fence = 5
    vals = [0, 0, 0, 0, 2, 2, 2, 2, 5, 6]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "ride_id long, ridership long")
    f = features.iqr_fences(df).first()
    assert (f.q1, f.q3, f.upper) == (0.0, 2.0, 5.0)
    kept = sorted(r.ridership for r in features.drop_outliers(df).collect())
    assert kept == [0, 0, 0, 0, 2, 2, 2, 2, 5]


def test_chart_titles_with_and_without_month(spark):
    rows = [(1, _ts(1), "34 St/Penn (A C)", "X", FARES[0], "omny", 3)]
    s = daily.station_series(ranking.with_ts(_rides(spark, rows)), 2024)
    with_month = daily.chart_titles(s, 2024, "All", "omny", 1).first()
    no_month = daily.chart_titles(s, 2024, "All", "omny").first()
    assert with_month.title == "Daily Ridership at 34 St/Penn (A C)\nAll, omny, January 2024"
    assert with_month.file_name == "34_St_Penn_(A_C)_2024_january_barchart.png"
    assert no_month.title == "Daily Ridership at 34 St/Penn (A C)\nAll, omny, 2024"
    assert no_month.file_name == "34_St_Penn_(A_C)_2024_barchart.png"


def test_stations_in_borough_from_selector_domains(spark):
    rows = [(1, _ts(1), "A", "North", FARES[0], "omny", 3), (2, _ts(2), "B", "South", FARES[1], "metrocard", 4),
            (3, _ts(3), "C", "North", FARES[0], "omny", 5)]
    dom = daily.selector_domains(ranking.with_ts(_rides(spark, rows)))
    assert sorted(r.value for r in daily.stations_in(dom, "North").collect()) == ["A", "C"]
    assert sorted(r.value for r in daily.stations_in(dom).collect()) == ["A", "B", "C"]
    by_domain = {d: sorted(r.value for r in dom.filter(F.col("domain") == d).collect())
                 for d in ["borough", "payment_method", "year"]}
    assert by_domain == {"borough": ["North", "South"], "payment_method": ["metrocard", "omny"], "year": ["2024"]}


def test_negative_ids_split_like_others(spark):
    from turnstile.operators import stats
    df = spark.range(100_000).select(F.xxhash64("id").alias("ride_id"))
    share = df.select(F.avg(stats.is_validation("ride_id").cast("double"))).first()[0]
    assert 0.18 < share < 0.22


def test_exact_quantiles_equal_numpy(spark):
    import numpy as np

    from turnstile.operators import stats
    rng = np.random.default_rng(0)
    for values in (rng.integers(0, 5, 300), rng.normal(size=1001), np.array([3.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
        assert np.allclose(stats.exact_quantiles(df, "v", probs), np.quantile(values, probs))
    assert stats.exact_quantiles(df.where("v > 9"), "v", [0.5]) == [None]


def test_last_day_of_the_holiday_span(spark):
    df = spark.sql("select timestamp_ntz'2100-12-31 05:00:00' ts union all select timestamp_ntz'2100-12-30 05:00:00'")
    assert [r.is_holiday for r in features.calendar_features(df).orderBy("ts").collect()] == [0, 1]


def test_series_by_id_covers_the_whole_station(spark):
    rows = [("1", "A", 5), ("2", "A", 7), ("3", "B", 9)]
    df = spark.createDataFrame(rows, "station_complex_id string, station_complex string, ridership long")
    df = df.withColumns({"ts": F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), "fare_class_category": F.lit("x"), "payment_method": F.lit("y")})
    assert [r.total_ridership for r in daily.station_series(df, 2024, station="1").collect()] == [12]
    assert [r.total_ridership for r in daily.station_series(df, 2024, station="A").collect()] == [12]


def test_validation_rows_do_not_move_the_scaler(spark):
    from turnstile.ml import model as ml
    from turnstile.schemas import CATEGORICAL_FEATURES, NUMERIC_FEATURES
    base = spark.range(100).withColumn("is_validation", F.col("id") >= 50).withColumn("label", F.rand(1)).withColumn("ride_id", F.col("id"))
    df = base.withColumns({c: F.col("id").cast("double") for c in NUMERIC_FEATURES} | {c: F.lit("a") for c in CATEGORICAL_FEATURES})
    moved = base.withColumns({c: F.when(F.col("id") >= 50, 1e6).otherwise(F.col("id")).cast("double") for c in NUMERIC_FEATURES}
                             | {c: F.lit("a") for c in CATEGORICAL_FEATURES})
    params = ml.GBTParams(maxIter=1, maxDepth=1)
    row = df.limit(1)
    scaled = [ml.fit(x, params).stages[0].transform(row).select(*[f"`{c}`" for c in NUMERIC_FEATURES]).first() for x in (df, moved)]
    assert scaled[0] == scaled[1]
