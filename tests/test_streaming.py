"""Structured Streaming forms of the daily aggregate."""

import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from turnstile import fixtures
from turnstile.operators import daily
from turnstile.operators.ranking import with_ts
from turnstile.sources.adapters import rides
from turnstile.streaming import daily as sd


def test_watermarked_stream_emits_closed_days_once(spark, tmp_path):
    landing, out, ckpt = (str(tmp_path / n) for n in ("landing", "out", "ckpt"))
    r = rides(spark, SF_SMALL, "events")
    fixtures.land_files(r, landing, n_files=3)
    q = (sd.daily_with_watermark(sd.ride_stream(spark, landing))
         .writeStream.outputMode("append").format("parquet")
         .option("path", out).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(out)
    batch = daily.daily_ridership(with_ts(r))
    last_day = batch.agg(F.max("date")).first()[0]
    expect = batch.filter(F.col("date") < F.lit(last_day))
    assert os.path.isdir(out)
    # every emitted row is final and equals the batch value; closed days are all there
    cols = daily.DAILY_KEYS + ["daily_ridership"]
    assert got.select(*cols).subtract(batch.select(*cols)).count() == 0
    assert expect.select(*cols).subtract(got.select(*cols)).count() == 0


def test_complete_stream_equals_batch(spark, tmp_path):
    landing, out, ckpt = (str(tmp_path / n) for n in ("landing", "out", "ckpt"))
    r = rides(spark, SF_SMALL, "events")
    fixtures.land_files(r, landing, n_files=3)
    sd.run_daily(spark, landing, out, ckpt, files_per_trigger=1)
    got = spark.read.parquet(out).select(*daily.DAILY_KEYS, "daily_ridership")
    batch = daily.daily_ridership(with_ts(r)).select(*daily.DAILY_KEYS, "daily_ridership")
    assert got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0
