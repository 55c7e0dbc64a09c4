"""File sources and sinks, read back from fresh folders."""

import gzip
import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from turnstile import fixtures
from turnstile.operators import daily, weather
from turnstile.operators.ranking import with_ts
from turnstile.sources import files
from turnstile.sources.adapters import rides


def test_published_csv_layout_reads_by_header(spark, tmp_path):
    # header order differs from ours, an extra Georeference column, no ride id
    r = rides(spark, SF_SMALL, "events").drop("ride_id")
    cols = ["transit_timestamp", "transit_mode", "station_complex_id", "station_complex", "borough",
            "payment_method", "fare_class_category", "ridership", "latitude", "longitude"]
    pub = r.select(*cols, F.format_string("POINT (%s %s)", "longitude", "latitude").alias("Georeference"))
    path = str(tmp_path / "pub")
    pub.write.option("header", True).csv(path)
    back = files.read_ridership_csv(spark, path)
    assert "Georeference" in back.columns and dict(back.dtypes)["ridership"] == "bigint"
    assert back.select("ride_id").distinct().count() == back.count() == r.count()
    got = daily.daily_ridership(with_ts(back)).agg(F.sum("daily_ridership")).first()[0]
    assert got == r.agg(F.sum("ridership")).first()[0]


def test_partitioned_parquet_round_trip(spark, tmp_path):
    r = rides(spark, SF_SMALL, "events")
    path = str(tmp_path / "p")
    files.write_partitioned(r, path)
    back = files.read_parquet(spark, path)
    assert back.columns[-2:] == ["transit_mode", "borough"] and back.count() == r.count()


def test_enrich_from_yearly_weather_files(spark, tmp_path):
    r = with_ts(rides(spark, SF_SMALL, "events"))
    w = fixtures.derive_weather(r)
    early, late = str(tmp_path / "w1"), str(tmp_path / "w2")
    w.filter(F.col("time") < "2024-01-16").write.option("header", True).csv(early)
    w.filter(F.col("time") >= "2024-01-16").write.option("header", True).csv(late)
    from_files = weather.enrich_from_files(r, [early, late])
    direct = weather.enrich(r, weather.typed_weather(w))
    cols = ["ride_id", "temperature_C", "precipitation_mm", "`humidity_%`"]
    assert from_files.select(*cols).exceptAll(direct.select(*cols)).count() == 0
    assert from_files.count() == r.count()


def _reply(path, status, station, start, body):
    folder = path / f"status={status}" / f"station_id={station}" / f"start_date={start}"
    folder.mkdir(parents=True)
    (folder / "reply.json").write_text(body)


def test_reply_files_are_flattened_rejected_and_missed(spark, tmp_path):
    body = '{"latitude": 40.7, "longitude": -73.9, "hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], ' \
           '"temperature_2m": [1.5, null], "precipitation": [0.0, 2.0], "relative_humidity_2m": [40, 41]}}'
    landing = tmp_path / "replies"
    _reply(landing, 200, 1, "2024-01-01", body)
    _reply(landing, 500, 1, "2024-02-01", '{"error": true, "reason": "limit"}')
    _reply(landing, 200, 2, "2024-01-01", '{"latitude": 40.7, "hourly": {"time": [')     # cut off
    _reply(landing, 200, 3, "2024-01-01", '{"latitude": 40.7}')
    _reply(landing, 200, 9, "2024-01-01", body)                                          # not in the table
    coordinates = spark.createDataFrame([(1, 40.6867, -73.95773), (2, 40.5, -74.0), (3, 40.4, -74.0), (4, 40.3, -74.0)],
                                        "station_id long, latitude double, longitude double")
    replies = weather.read_reply_files(spark, str(landing))
    assert replies.filter(F.col("origin").endswith("status=200/station_id=1/start_date=2024-01-01/reply.json")).count() == 1
    hours = {(r.station_id, r.time): (r.temperature_C, r["humidity_%"], r.latitude) for r in weather.flatten_replies(replies, coordinates).collect()}
    assert hours == {(1, "2024-01-01T00:00"): (1.5, 40.0, 40.6867), (1, "2024-01-01T01:00"): (None, 41.0, 40.6867),
                     (9, "2024-01-01T00:00"): (1.5, 40.0, None), (9, "2024-01-01T01:00"): (None, 41.0, None)}
    bad = {(r.station_id, r.status): r.reason for r in weather.rejected_replies(replies).collect()}
    assert bad == {(1, 500): "limit", (2, 200): "unreadable body", (3, 200): "no hourly data"}
    missed = {r.station_id: (r.n_failed, r.latitude) for r in weather.stations_without_reply(coordinates, replies).collect()}
    assert missed == {2: (1, 40.5), 3: (1, 40.4), 4: (0, 40.3)}


def test_files_of_mixed_headers_and_malformed_lines(spark, tmp_path):
    def land(name, text, pack=False):
        (tmp_path / "csv").mkdir(exist_ok=True)
        data = text.encode()
        (tmp_path / "csv" / name).write_bytes(gzip.compress(data) if pack else data)

    land("a.csv", "station_complex,ridership,transit_timestamp,latitude\nA,1,01/01/2024 01:00:00 AM,40.5\nB,x,bad,n/a\nC,2\n")
    land("b.csv", 'transit_timestamp,"extra,col",station_complex,ridership\n01/01/2024 01:00:00 PM,e,"A, b",3\n1,2,3,4,5\n')
    land("c.csv.gz", "station_complex,ridership,transit_timestamp,latitude\nD,4,01/01/2024 02:00:00 AM,40.5\n", pack=True)
    land("empty.csv", "")
    path = str(tmp_path / "csv")
    assert sorted(len(p) for p in files.files_by_header(spark, path).values()) == [1, 2]
    got = files.read_ridership_csv(spark, path)
    assert sorted((r.station_complex, r.ridership, r.latitude, r["extra,col"]) for r in got.collect()) == [
        ("A", 1, 40.5, None), ("A, b", 3, None, "e"), ("B", None, None, None), ("D", 4, 40.5, None)]
    # pruning columns does not change which lines are rejected
    assert got.select("station_complex").count() == got.count() == 4
    lines = sorted((os.path.basename(r.file), r.line) for r in files.rejected_csv_lines(spark, path).collect())
    assert lines == [("a.csv", "C,2"), ("b.csv", "1,2,3,4,5")]


def test_equal_rows_share_their_id_in_any_layout(spark, tmp_path):
    (tmp_path / "x.csv").write_text("station_complex,ridership\nA,1\nB,2\n")
    (tmp_path / "y.csv").write_text("ridership,station_complex\n1,A\n")
    ids = {(r.station_complex, r.ride_id) for r in files.read_ridership_csv(spark, str(tmp_path)).collect()}
    assert len(ids) == 2


def test_weather_joins_by_millionths_of_a_degree(spark):
    ride = spark.createDataFrame([(1, 40.6867, -73.95773), (2, 40.6867, -73.95774), (3, None, -73.95773)],
                                 "ride_id long, latitude double, longitude double").withColumn("ts", F.lit("2024-01-01 05:00:00").cast("timestamp_ntz"))
    w = spark.createDataFrame([(40.6867000004, -73.9577299996, 3.5)], "latitude double, longitude double, temperature_C double")
    w = w.withColumns({"weather_ts": F.lit("2024-01-01 05:00:00").cast("timestamp_ntz"), "precipitation_mm": F.lit(0.0), "humidity_%": F.lit(1.0)})
    got = weather.enrich(ride, w)
    assert {r.ride_id: r.temperature_C for r in got.collect()} == {1: 3.5, 2: None, 3: None}
    assert got.columns == ["ride_id", "latitude", "longitude", "ts", "temperature_C", "precipitation_mm", "humidity_%"]
