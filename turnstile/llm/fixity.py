"""Fixity audit of WARC replicas with Merkle trees.

A file's records are its leaves, in the order of their offsets.  Level 0
hashes records; a node of level ``n`` covers the offset range
``[i * span_n, (i + 1) * span_n)`` and hashes its children's hashes in order.
Ranges are fixed by offsets alone, so a lost or grown record does not move
the ranges of intact ones.  Two replicas are compared from their roots down:
only children of ranges that differ are read at the next level, until the
differing records are found.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstile.llm.scratch import Scratch

LEAF_SPAN = 64 << 10      # bytes of a level-1 range
FANOUT = 16               # ranges of a level in one range of the next
FILE_RECORDS = 1000       # records of a file that warc_records lays out


def warc_records(pages: DataFrame, file_records: int = FILE_RECORDS) -> DataFrame:
    """Response records ``file, offset, record_id, record`` of pages.

    Pages go to files by id, ``file_records`` ids each, and stand in a file
    in the order of their ids; an offset is the sum of the lengths before it.
    A null url or html is empty; a null page id goes to file -1.
    """
    url, html = F.coalesce(F.col("url").cast("string"), F.lit("")), F.coalesce(F.col("html").cast("string"), F.lit(""))
    page = F.col("page_id").cast("long")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "),
                    F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    rows = pages.select(F.coalesce(F.expr(f"cast(page_id as bigint) div {file_records}"), F.lit(-1).cast("long")).alias("file"),
                        page.alias("record_id"), F.concat(head, html, F.lit("\r\n\r\n")).alias("record"))
    size = F.octet_length("record").cast("long")
    order = Window.partitionBy("file").orderBy("record_id", F.sha2("record", 256))
    return rows.withColumn("offset", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size).select(
        "file", "offset", "record_id", "record")


def _hash_in_order(*order: str) -> Column:
    """Hash of the hashes of a group, in order."""
    items = F.array_sort(F.collect_list(F.struct(*order, "hash")))
    return F.sha2(F.array_join(F.transform(items, lambda x: x["hash"]), ""), 256)


def leaves(records: DataFrame) -> DataFrame:
    """Level 0: ``file, offset, record_id, hash``; a null record hashes as an empty one."""
    body = F.coalesce(F.col("record").cast("string"), F.lit(""))
    return records.select(F.col("file").cast("long").alias("file"), F.col("offset").cast("long").alias("offset"),
                          F.col("record_id").cast("long").alias("record_id"),
                          F.sha2(F.concat_ws("|", F.octet_length(body).cast("string"), body), 256).alias("hash"))


def _lowest(level0: DataFrame) -> DataFrame:
    """Level 1: one hash for each range of LEAF_SPAN bytes that holds a record's start."""
    return level0.groupBy("file", F.expr(f"offset div {LEAF_SPAN}").alias("part")).agg(
        _hash_in_order("offset", "record_id").alias("hash"))


def _above(level: DataFrame) -> DataFrame:
    """The next level: one hash for each FANOUT neighbouring ranges."""
    return level.withColumnRenamed("part", "child").groupBy("file", F.expr(f"child div {FANOUT}").alias("part")).agg(
        _hash_in_order("child").alias("hash"))


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """Records that differ between two replicas.

    Both have ``file, offset, record_id, record``.  Returns ``file, offset,
    record_id, status, left_hash, right_hash`` with status ``changed``,
    ``missing`` (only left) or ``extra`` (only right); a record that moved is
    missing at one offset and extra at the other.  A level-1 range holds at
    most its 64 KiB of record starts, any other range 16 ranges.  Null keys
    compare equal to null keys; records repeated at one place are compared by
    the concatenation of their hashes; other columns are ignored; an empty
    replica makes all records of the other missing or extra.
    """
    scratch = Scratch(left.sparkSession, "fixity")
    sides = [scratch.write(leaves(x), "leaves") for x in (left, right)]
    far = max([s.agg(F.max("offset")).first()[0] or 0 for s in sides])
    levels = 1 + max(0, math.ceil(math.log(max(1, far // LEAF_SPAN + 1), FANOUT) - 1e-9))
    trees = []
    for s in sides:
        made = [scratch.write(_lowest(s), "level")]
        for _ in range(levels - 1):
            made.append(scratch.write(_above(made[-1]), "level"))
        trees.append(made)

    suspects = None
    for n in reversed(range(levels)):
        a, b = trees[0][n], trees[1][n]
        if suspects is not None:
            a, b = (x.withColumn("above", F.expr(f"part div {FANOUT}")).join(
                suspects.select(F.col("file").alias("file_"), F.col("part").alias("above_")),
                F.col("file").eqNullSafe(F.col("file_")) & F.col("above").eqNullSafe(F.col("above_")), "left_semi") for x in (a, b))
        suspects = scratch.write(_differing(a, b, ["file", "part"]).select("file", "part"), "suspects")
    below = [s.withColumn("part", F.expr(f"offset div {LEAF_SPAN}")).join(
        suspects.select(F.col("file").alias("file_"), F.col("part").alias("part_")),
        F.col("file").eqNullSafe(F.col("file_")) & F.col("part").eqNullSafe(F.col("part_")), "left_semi") for s in sides]
    keys = ["file", "offset", "record_id"]
    folded = [x.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("hash")), "").alias("hash")) for x in below]
    found = _differing(*folded, keys)
    status = F.when(F.col("right_hash").isNull(), "missing").when(F.col("left_hash").isNull(), "extra").otherwise("changed")
    return found.select(*keys, status.alias("status"), "left_hash", "right_hash")


def _differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose hashes differ or that one side lacks: a union and one aggregate, no outer join."""
    both = a.select(*keys, F.col("hash").alias("l"), F.lit(None).cast("string").alias("r")).union(
        b.select(*keys, F.lit(None).cast("string").alias("l"), F.col("hash").alias("r")))
    merged = both.groupBy(*keys).agg(F.max("l").alias("left_hash"), F.max("r").alias("right_hash"))
    return merged.where(~F.col("left_hash").eqNullSafe(F.col("right_hash")))
