"""Whole-table properties over the provided data."""

import math

from pyspark.sql import functions as F

from conftest import SF_SMALL
from turnstile import fixtures
from turnstile.ml import model as ml
from turnstile.operators import daily, features, ranking, stats
from turnstile.plans.q_weather import enriched
from turnstile.schemas import CATEGORICAL_FEATURES
from turnstile.sources.adapters import rides


def test_totals_agree(spark):
    r = ranking.with_ts(rides(spark, SF_SMALL, "events"))
    fact = r.agg(F.sum("ridership")).first()[0]
    d = daily.daily_ridership(r).agg(F.sum("daily_ridership")).first()[0]
    s = daily.station_map(r).agg(F.sum("total_ridership")).first()[0]
    assert fact == d == s


def test_left_join_keeps_fact_rows(spark):
    r = ranking.with_ts(rides(spark, SF_SMALL, "events"))
    e = enriched(spark, SF_SMALL)
    assert e.count() == r.count()
    assert e.filter(F.col("temperature_C").isNull()).count() > 0     # missing hours exist


def test_scaled_columns_mean_zero_pop_std_one(spark):
    df = features.feature_frame(enriched(spark, SF_SMALL))
    row = df.agg(*[F.avg(F.col(f"`{c}`")).alias(f"m{i}") for i, c in enumerate(["hour", "temperature_C"])],
                 *[F.stddev_pop(F.col(f"`{c}`")).alias(f"s{i}") for i, c in enumerate(["hour", "temperature_C"])]).first()
    assert abs(row.m0) < 1e-9 and abs(row.m1) < 1e-9
    assert abs(row.s0 - 1) < 1e-9 and abs(row.s1 - 1) < 1e-9


def test_one_hot_slots(spark):
    r = rides(spark, SF_SMALL, "events")
    d = features.category_dictionary(r, CATEGORICAL_FEATURES)
    idx = features.one_hot_index(r, d, CATEGORICAL_FEATURES, ["ride_id"])
    assert idx.filter(" OR ".join(f"{c}_index IS NULL" for c in CATEGORICAL_FEATURES)).count() == 0
    n = {row.column: row.n for row in d.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n["payment_method"] == 2


def test_split_is_deterministic_and_about_20_percent(spark):
    r = rides(spark, SF_SMALL, "events")
    a = stats.with_split(r).filter("is_validation").count()
    b = stats.with_split(r.repartition(7)).filter("is_validation").count()
    assert a == b and 0.1 < a / r.count() < 0.3


def test_log_round_trip(spark):
    r = rides(spark, SF_SMALL, "events")
    bad = r.filter(F.abs(F.expm1(F.log1p("ridership")) - F.col("ridership")) > 1e-6).count()
    assert bad == 0


def test_weather_grid_covers_every_station_hour(spark):
    r = ranking.with_ts(rides(spark, SF_SMALL, "events"))
    w = fixtures.derive_weather(r)
    n_st = r.select("station_complex_id").distinct().count()
    assert w.select("station_id").distinct().count() == n_st
    assert w.filter(F.col("temperature_C") == "n/a").count() > 0


def test_unknown_category_scores_all_zero_and_prediction_nonnegative(spark, tmp_path):
    df = ml.training_frame(features.feature_frame(enriched(spark, SF_SMALL), scale=False))
    model = ml.fit(df, ml.GBTParams(maxIter=5, maxDepth=3))
    path = str(tmp_path / "m")
    ml.save(model, path)
    back = ml.load(path)
    probe = df.limit(3).withColumn("station_complex", F.lit("Nowhere (0)"))
    out = back.transform(probe).select("station_complex_vec", "prediction").collect()
    assert all(v.station_complex_vec.numNonzeros() == 0 for v in out)
    pred = ml.predict(back, df).agg(F.min("predicted_ridership")).first()[0]
    assert pred >= 0
    m = stats.regression_metrics(ml.predict(back, df.filter("is_validation"))).first()
    assert math.isfinite(m.rmse) and m.n > 0


def test_one_hot_vectors_have_one_slot_per_known_category(spark):
    df = ml.training_frame(features.feature_frame(enriched(spark, SF_SMALL), scale=False))
    model = ml.fit(df, ml.GBTParams(maxIter=2, maxDepth=2))
    out = model.transform(df).select(*[f"{c}_vec" for c in CATEGORICAL_FEATURES]).collect()
    assert all(r[i].numNonzeros() == 1 and r[i].toArray().sum() == 1.0
               for r in out for i in range(len(CATEGORICAL_FEATURES)))


def test_patience_rule():
    assert ml.best_iteration([5, 4, 3, 3.5, 3.6, 3.7], patience=2) == 3
    assert ml.best_iteration([5, 4, 3, 3.5, 2.0], patience=5) == 5
    assert ml.best_iteration([1.0], patience=50) == 1


def test_pipeline_scaler_equals_checked_scaling(spark):
    from turnstile.ml.scaler import PopulationScaler
    from turnstile.schemas import SCALED_FEATURES
    df = features.feature_frame(enriched(spark, SF_SMALL), scale=False)
    by_stage = PopulationScaler(inputCols=list(SCALED_FEATURES)).fit(df).transform(df)
    by_query = features.scale_columns(df)
    cols = ["ride_id", *[F.round(F.col(f"`{c}`"), 9).alias(c) for c in SCALED_FEATURES]]
    assert by_stage.select(*cols).exceptAll(by_query.select(*cols)).count() == 0


def test_scoring_features_match_training_features(spark):
    from turnstile.operators import requests
    from turnstile.operators.ranking import with_ts
    r = rides(spark, SF_SMALL, "events")      # January 2024: New Year's Day and MLK Day inside
    v = requests.validate(fixtures.requests_from_rides(r), requests.domains(r))
    scored = requests.request_features(v).select(
        F.col("request_id").alias("ride_id"), "hour", "day_of_week", "month", "is_weekend", "is_holiday")
    trained = features.calendar_features(with_ts(r)).select(
        "ride_id", "hour", "day_of_week", "month", "is_weekend", "is_holiday")
    joined = scored.join(trained, "ride_id")
    assert joined.count() == scored.count() > 0
    assert scored.exceptAll(trained.join(scored.select("ride_id"), "ride_id")).count() == 0
    assert trained.filter("is_holiday = 1").join(scored, "ride_id").count() > 0
