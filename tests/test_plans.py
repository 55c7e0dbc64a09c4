"""Physical-plan properties that matter at scale (checked on the executed plans)."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF_SMALL
from turnstile.operators import daily, features, profile
from turnstile.operators.ranking import with_ts
from turnstile.sources import files
from turnstile.sources.adapters import rides

QUERIES = entry.queries()
SLOW = {"tuned_trials", "model_validation_metrics", "batch_predictions"}
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in SLOW))
def test_no_cross_join_no_python_no_subquery_fanout(spark, name):
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    assert not [k for k in FORBIDDEN if k in plan]
    assert len(re.findall(r"\bSubquery subquery", plan)) <= 2


def test_scan_reads_only_needed_columns(spark):
    plan = _plan(daily.daily_ridership(with_ts(rides(spark, SF_SMALL, "events"))))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all("props" not in s for s in schemas)


def test_partition_filter_prunes_directories(spark, tmp_path):
    path = str(tmp_path / "p")
    files.write_partitioned(rides(spark, SF_SMALL, "events"), path)
    plan = _plan(files.read_parquet(spark, path).filter(F.col("borough") == "Borough 1").groupBy("transit_mode").count())
    assert re.search(r"PartitionFilters: \[[^\]]*borough", plan)


def test_top_k_is_not_a_full_sort(spark):
    from turnstile.operators import ranking
    plan = _plan(ranking.top_stations(with_ts(rides(spark, SF_SMALL, "events")), 10))
    assert "TakeOrderedAndProject" in plan


def test_lag_windows_over_fact_rows_are_keyed_by_range_alone(spark):
    lagged = features.lag_features(with_ts(rides(spark, SF_SMALL, "events")))
    plan = lagged._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    windows = [i for i, x in enumerate(lines) if "Window [" in x]
    keys = {i: re.search(r"\], \[(_range|_pk)#\d+L?\], \[_at#", lines[i])[1] for i in windows}
    assert sorted(set(keys.values())) == ["_pk", "_range"]
    for i, key in keys.items():
        if key == "_pk":              # only edge rows come here: the next step below keeps first and last rows
            below = [x for x in lines[i + 1:next((j for j in windows if j > i), len(lines))] if "Filter" in x]
            assert below and "OR" in below[0]
    # and the range layout is a shuffle by (station, order), so a hot station has many ranges
    layout = laid_out(spark)
    assert "rangepartitioning(_pk" in layout and "ts#" in layout


def laid_out(spark):
    """Plan of the write below the lags."""
    from turnstile.operators import features as module
    seen = []
    keep, module.materialize = module.materialize, lambda df, name="x": seen.append(_plan(df)) or keep(df, name)
    try:
        module.lag_features(with_ts(rides(spark, SF_SMALL, "events")))
    finally:
        module.materialize = keep
    return seen[0]


def test_helpers(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    dup = df.select("a", "b", F.col("a").alias("a"))
    assert features.unique_columns(dup).columns == ["a", "b"]
    assert daily.is_empty(df.filter("a > 5")) and not daily.is_empty(df)
    assert profile.preview(df, 1).count() == 1


def test_dense_columns_come_from_the_data_and_clashes_are_told_apart(spark):
    df = spark.createDataFrame([(1, "x y", "p"), (2, "x/y", None), (3, None, "q")], "id int, c string, d string")
    flat = features.one_hot_dense(df, ["c", "d"])
    assert flat.columns == ["id", "c_x_y", "c_x_y__2", "d_p", "d_q"]
    assert sorted(tuple(r) for r in flat.collect()) == [(1, 1, 0, 1, 0), (2, 0, 1, 0, 0), (3, 0, 0, 0, 1)]
    new = spark.createDataFrame([(4, "unseen", "q")], "id int, c string, d string")
    scored = features.one_hot_dense(new, ["c", "d"], features.category_dictionary(df, ["c", "d"]))
    assert scored.columns == flat.columns and [tuple(r) for r in scored.collect()] == [(4, 0, 0, 0, 1)]
    with pytest.raises(ValueError):
        features.dense_columns(features.category_dictionary(df, ["c", "d"]), most=3)


def test_weather_join_falls_back_to_shuffle_join_when_large(spark):
    from turnstile import fixtures
    from turnstile.operators import weather
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:                       # as if the weather table were too large
            spark.conf.set(k, "-1")
        r = with_ts(rides(spark, SF_SMALL, "events"))
        df = weather.enrich(r, weather.typed_weather(fixtures.derive_weather(r)))
        df.write.format("noop").mode("overwrite").save()
        plan = _plan(df)
        assert "SortMergeJoin" in plan and "LeftOuter" in plan and "BroadcastHashJoin" not in plan
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
