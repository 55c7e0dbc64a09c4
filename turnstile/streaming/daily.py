"""Incremental daily ridership with Structured Streaming.

Ridership files land in a folder over time; the same daily aggregate as
``operators.daily.daily_ridership`` is kept up to date by a streaming query.
State is one row per (station, borough, fare class, payment method, day),
kept in the checkpoint folder so a restarted or failed query resumes exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.operators.daily import daily_ridership
from turnstile.operators.ranking import with_ts
from turnstile.schemas import RAW_RIDES


def ride_stream(spark: SparkSession, landing_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet ride files as a stream (fixed schema, no inference)."""
    r = spark.readStream.schema(RAW_RIDES)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(landing_dir)


def run_daily(spark: SparkSession, landing_dir: str, output_dir: str, checkpoint_dir: str,
              files_per_trigger: int | None = None) -> None:
    """Process every landed file (``availableNow``) and leave the full daily table in ``output_dir``.

    ``complete`` output re-emits the whole (small) aggregate each micro-batch
    and ``foreachBatch`` overwrites the Parquet table with it.  The table is
    whole when this returns; while a batch is written, readers may find it
    empty or in part.
    """
    agg = daily_ridership(with_ts(ride_stream(spark, landing_dir, files_per_trigger)))

    def write(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(output_dir)

    q = (agg.writeStream.outputMode("complete")
         .option("checkpointLocation", checkpoint_dir)
         .foreachBatch(write)
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()


def wallclock_instant(ts_ntz) -> "F.Column":
    """TIMESTAMP_NTZ wall clock -> TIMESTAMP instant at the same UTC wall clock.

    Epoch seconds are computed from the calendar fields, so no session zone
    enters; event-time windows of one day are then wall-clock days.
    """
    c = F.col(ts_ntz) if isinstance(ts_ntz, str) else ts_ntz
    secs = (F.datediff(F.to_date(c), F.lit("1970-01-01")).cast("long") * 86400
            + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c))
    return F.timestamp_seconds(secs)


def instant_day(ts) -> "F.Column":
    """Inverse of ``wallclock_instant`` at day precision (zone-free)."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds(ts) / 86400).cast("int"))


def daily_with_watermark(rides_stream: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Long-running form: event-time day windows closed by a watermark.

    Rows later than ``lateness`` behind the newest seen hour are dropped by
    the engine, and a day's state is released once the watermark passes its
    end, so state stays bounded by the open days.  Use ``append`` output:
    each (station, fare class, payment method, day) row is emitted once, final.
    """
    ts = (with_ts(rides_stream).withColumn("event_time", wallclock_instant("ts"))
          .withWatermark("event_time", lateness))
    day = instant_day(F.col("day.start"))
    return (ts.groupBy("station_complex", "borough", "fare_class_category", "payment_method",
                       F.window("event_time", "1 day").alias("day"))
            .agg(F.sum("ridership").cast("long").alias("daily_ridership"))
            .select("station_complex", "borough", "fare_class_category", "payment_method",
                    F.year(day).alias("year"), day.alias("date"), "daily_ridership"))
