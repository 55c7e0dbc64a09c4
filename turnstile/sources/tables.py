"""Readers for the provided parquet tables.

Only the columns an operator needs are selected, so Catalyst prunes the
parquet ``ReadSchema`` and pushes filters into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


# Per-application memo of scanned tables: the file listing and footer read happen
# once per table, not once per query.  Tables are read-only inputs.
_SCANS: dict[tuple[str, str], DataFrame] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    path = table_path(sf_dir, name)
    key = (spark.sparkContext.applicationId, path)
    df = _SCANS.get(key)
    if df is None:
        df = _SCANS[key] = spark.read.parquet(path)
    return df.select(*columns) if columns else df
