"""The stored daily aggregate, kept up to date by the days that changed.

One folder per day.  A refresh recomputes the changed days from the typed
fact sink and overwrites their folders alone, so it can be repeated safely
and its cost follows the new rows and not the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.operators.daily import DAILY_KEYS, daily_ridership

SCHEMA = T.StructType([
    T.StructField("station_complex", T.StringType()),
    T.StructField("borough", T.StringType()),
    T.StructField("fare_class_category", T.StringType()),
    T.StructField("payment_method", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("daily_ridership", T.LongType()),
    T.StructField("date", T.DateType()),
])


def _write(daily: DataFrame, path: str, overwrite: str) -> None:
    (daily.hint("rebalance", "date").write.mode("overwrite").option("partitionOverwriteMode", overwrite)
     .partitionBy("date").parquet(path))


def write(rides_ts: DataFrame, path: str) -> None:
    """The whole table, from all fact rows."""
    _write(daily_ridership(rides_ts), path, "static")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path).select(*DAILY_KEYS, "daily_ridership")


def changed_days(new_rides_ts: DataFrame) -> list:
    """Days of new rows, null for rows without a time: at most one value per day of the calendar."""
    return [r[0] for r in new_rides_ts.select(F.to_date("ts").alias("day")).distinct().collect()]


def refresh(facts: DataFrame, path: str, days: list) -> None:
    """Recompute ``days`` from all their fact rows and overwrite their folders.

    ``facts`` is the typed sink, read after the new rows were appended: the
    days' years and months prune its folders.  Folders of other days are not
    touched.  Rows are only ever added: a day that lost all of its rows keeps
    its folder.
    """
    dated = [d for d in days if d is not None]
    if dated:
        months = sorted({(d.year, d.month) for d in dated})
        in_months = F.lit(False)
        for y, m in months:
            in_months = in_months | ((F.col("year") == y) & (F.col("month") == m))
        _write(daily_ridership(facts.filter(in_months & F.to_date("ts").isin(dated))), path, "dynamic")
    if len(dated) < len(days):
        _write(daily_ridership(facts.filter(F.col("year").isNull() & F.col("ts").isNull())), path, "dynamic")
