"""File sources and sinks.

Readers always pass a fixed schema (no ``inferSchema`` pass over the data).
Writers cluster rows by the output partition columns before writing, so each
task writes few files per directory instead of one per partition value.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.functions.timefmt import parse_transit_ts
from turnstile.schemas import RAW_RIDES, WEATHER_TEXT

PARTITION_COLUMNS = ["transit_mode", "borough"]


# Typed columns of a ridership CSV, found by header name (any order, extra columns kept).
REJECTED = "_rejected"
RIDE_TYPES = {"ridership": "long", "latitude": "double", "longitude": "double"}


def _first_line(spark: SparkSession, path: str) -> str | None:
    """First line of one file, decompressed by its name's codec; null for an empty file."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(conf).open(at)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(at)
        text = stream if codec is None else codec.createInputStream(stream)
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(text, "UTF-8")).readLine()
    finally:
        stream.close()


def files_by_header(spark: SparkSession, path) -> dict[str, list[str]]:
    """The files below ``path``, grouped by their header line.

    Spark itself reads one file's header and takes it for all; here every
    file's first line is read, a small read per listed file and no scan.
    """
    paths = spark.read.text(path).inputFiles()
    with ThreadPool(32) as pool:
        headers = pool.map(inheritable_thread_target(spark)(lambda p: _first_line(spark, p)), paths)
    groups: dict[str, list[str]] = {}
    for header, at in zip(headers, paths):
        if header is not None:
            groups.setdefault(header.lstrip("\ufeff"), []).append(at)
    return groups


def _csv_groups(spark: SparkSession, path) -> list[tuple[list[str], DataFrame]]:
    """Column names and rows of each header's files: all text, malformed lines kept in ``_rejected``."""
    out = []
    for header, paths in sorted(files_by_header(spark, path).items()):
        names = next(csv.reader([header]))
        schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, REJECTED]])
        # a line is malformed by its number of fields, so all of them are parsed
        raw = (spark.read.schema(schema).option("header", True).option("escape", '"').option("mode", "PERMISSIVE")
               .option("columnNameOfCorruptRecord", REJECTED).option("columnPruning", False).csv(paths))
        # always true; Spark refuses a plan that asks a raw file for nothing but its rejected lines
        out.append((names, raw.filter(F.length(F.concat_ws("", F.col(f"`{names[0]}`"))) >= 0)))
    return out


def read_ridership_csv(spark: SparkSession, path) -> DataFrame:
    """Ridership CSV files as published, each with a header naming its columns.

    Files are grouped by their header and united by column name, so layouts
    may be mixed; a column that a file lacks is null.  Columns are matched by
    header name (no positional schema, no inference pass): text as read,
    ``ridership``/``latitude``/``longitude`` typed with ``try_cast`` (bad text
    -> null), extra columns (e.g. ``Georeference``) kept.  Lines with too few
    or too many fields are left out here and reported by
    ``rejected_csv_lines``.  Without a ``ride_id`` column, one is derived as a
    hash of the row's text, whatever its layout: a deterministic tie-breaker
    for ordered windows (identical rows share it, and their values are
    identical too).
    """
    frames = []
    for names, raw in _csv_groups(spark, path):
        good = raw.filter(F.col(REJECTED).isNull())
        typed = good.select(*[F.col(f"`{c}`").try_cast(RIDE_TYPES[c]).alias(c) if c in RIDE_TYPES else F.col(f"`{c}`") for c in names],
                            *([] if "ride_id" in names else [F.xxhash64(*[F.col(f"`{c}`") for c in sorted(names)]).alias("ride_id")]))
        frames.append(typed.withColumn("ride_id", F.col("ride_id").try_cast("long")))
    if not frames:
        return spark.createDataFrame([], T.StructType([f for f in RAW_RIDES.fields]))
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)


def rejected_csv_lines(spark: SparkSession, path) -> DataFrame:
    """``file, line``: the malformed lines that ``read_ridership_csv`` leaves out."""
    frames = [raw.select(F.col("_metadata.file_path").alias("file"), F.col(REJECTED).alias("line")).filter("line is not null")
              for _, raw in _csv_groups(spark, path)]
    if not frames:
        return spark.createDataFrame([], "file string, line string")
    return reduce(DataFrame.unionByName, frames)


def read_weather_csv(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """Weather CSV files, one per year (A2): all text; several paths are one union scan (G1)."""
    return spark.read.schema(WEATHER_TEXT).option("header", True).csv(paths if isinstance(paths, str) else list(paths))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet directory (A3); with ``col=value`` sub-folders the partition columns come last (A4)."""
    return spark.read.parquet(path)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str] = PARTITION_COLUMNS,
                      compression: str = "snappy") -> None:
    """Overwrite a Parquet dataset partitioned by ``by``.

    The ``REBALANCE`` hint clusters rows by the directory columns (few files
    per directory) while letting AQE split a skewed value (one borough with
    a third of the rows) over several tasks and merge small ones;
    ``repartition(*by)`` would pin each directory value to a single task.
    """
    (df.hint("rebalance", *by)
       .write.mode("overwrite").option("compression", compression)
       .option("maxRecordsPerFile", 5_000_000)
       .partitionBy(*by).parquet(path))


# Folders of the typed sink.
TYPED_PARTITIONS = ["year", "month"]


def write_typed(rides: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Ride rows with their time parsed once, in folders by year and month.

    The text time is replaced by ``ts``; rows whose time does not parse stand
    in the folder of no year.  ``mode="append"`` lands more rows.
    """
    ts = F.col("ts") if "ts" in rides.columns else parse_transit_ts("transit_timestamp")
    typed = rides.withColumn("ts", ts).withColumns({"year": F.year("ts"), "month": F.month("ts")}).drop("transit_timestamp")
    (typed.hint("rebalance", *TYPED_PARTITIONS)
     .write.mode(mode).option("maxRecordsPerFile", 5_000_000).partitionBy(*TYPED_PARTITIONS).parquet(path))


def read_typed(spark: SparkSession, path: str) -> DataFrame:
    """The typed sink; filters on ``year`` and ``month`` prune folders (A4)."""
    fields = [f for f in RAW_RIDES.fields if f.name != "transit_timestamp"]
    extra = [T.StructField("ts", T.TimestampNTZType())] + [T.StructField(c, T.IntegerType()) for c in TYPED_PARTITIONS]
    return spark.read.schema(T.StructType(fields + extra)).parquet(path)


def write_csv(df: DataFrame, path: str, by: Sequence[str] | None = None) -> None:
    """Overwrite CSV with a header (A10); ``by`` gives one sub-folder per value."""
    w = df.write.mode("overwrite").option("header", True)
    if by:
        w = w.partitionBy(*by)
    w.csv(path)
