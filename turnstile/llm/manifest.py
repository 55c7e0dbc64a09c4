"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf.  A group's leaves ascend by key; while more than one node
remains, each two consecutive ones (the last run: maybe one) become the hash
of their digests.  What remains is the group's root, and the groups' roots
make one more tree in the order of their names.

The trees are swept in the order of node labels: a node's label is the last
leaf below it and its level, so children stand before parents.  A priority
queue ordered by label carries child digests forward to parents; a second,
reversed sweep carries proof suffixes from the root back to the leaves.  The
queue is external: aligned runs of ``RUN`` nodes of a group are blocks, each
swept by one task with a queue in memory, and the messages between blocks are
rows that Spark's sorted shuffle delivers.  A round of blocks climbs ten
levels, so a thousand million leaves take three.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstile.llm.scratch import Scratch

LEVELS = 10
RUN = 1 << LEVELS


def leaf_digest(*values) -> Column:
    """Hash of the values in order: ``-`` if null, else UTF-8 byte count, ``:``, value."""
    parts = []
    for v in values:
        text = (F.col(v) if isinstance(v, str) else v).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def height(total: int) -> int:
    """Levels that one round climbs above ``total`` nodes of a group."""
    return LEVELS if total > RUN else (total - 1).bit_length()


class Sweep:
    """Both sweeps over one block: ``digests`` in order, ``levels`` to climb to one node."""

    def __init__(self, digests: list[str], levels: int):
        self.n, self.levels = len(digests), levels
        self.nodes: list[list[str]] = [[] for _ in range(levels + 1)]
        queue: list[tuple[int, int, int, str]] = []      # last leaf below, level, index of the sender, its digest
        for leaf, digest in enumerate(digests):
            self._deliver(queue, 0, leaf, digest)
            while queue and queue[0][0] <= leaf:
                last, level, sender, text = heapq.heappop(queue)
                while queue and queue[0][:2] == (last, level):
                    text += heapq.heappop(queue)[3]
                self._deliver(queue, level, sender >> 1, sha256(text.encode()).hexdigest())

    def _last(self, level: int, index: int) -> int:
        return min((index + 1) << level, self.n) - 1

    def _deliver(self, queue, level: int, index: int, digest: str) -> None:
        self.nodes[level].append(digest)
        if level < self.levels:
            heapq.heappush(queue, (self._last(level + 1, index >> 1), level + 1, index, digest))

    @property
    def root(self) -> str:
        return self.nodes[-1][0]

    def proofs(self, siblings: str, sides: str) -> list[tuple[str, str]]:
        """Each leaf's siblings and their sides up to the top, given those of the block's root."""
        out = [("", "")] * self.n
        queue = [(-self._last(self.levels, 0), -self.levels, 0, siblings, sides)]
        while queue:
            _, level, index, text, side = heapq.heappop(queue)
            level = -level
            if level == 0:
                out[index] = (text, side)
                continue
            below = self.nodes[level - 1]
            left, right = 2 * index, 2 * index + 1
            if right < len(below):
                messages = [(left, below[right] + text, "R" + side), (right, below[left] + text, "L" + side)]
            else:
                messages = [(left, text, "-" + side)]
            for child, t, s in messages:
                heapq.heappush(queue, (-self._last(level - 1, child), 1 - level, child, t, s))
        return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """One table per block of a stream sorted by group and block (at most RUN + 1 rows each)."""
    parts, key = [], None
    for batch in batches:
        keys = list(zip(batch["grp"].to_pylist(), batch["block"].to_pylist()))
        begin = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[begin]:
                continue
            if parts and keys[begin] != key:
                yield pa.Table.from_batches(parts)
                parts = []
            key = keys[begin]
            parts.append(batch.slice(begin, i - begin))
            begin = i
    if parts:
        yield pa.Table.from_batches(parts)


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("grp", pa.string()), ("place", pa.int64()), ("total", pa.int64()), ("digest", pa.string())])
    out = []
    for table in _blocks(batches):
        total = table["total"][0].as_py()
        out.append((table["grp"][0].as_py(), table["block"][0].as_py(), -(-total // RUN),
                    Sweep(table["digest"].to_pylist(), height(total)).root))
        if len(out) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _blocks(batches):
        message, nodes = table.slice(0, 1), table.slice(1)
        if len(nodes) == 0:                      # an empty table's root
            continue
        sweep = Sweep(nodes["digest"].to_pylist(), height(nodes["total"][0].as_py()))
        found = sweep.proofs(message["siblings"][0].as_py(), message["sides"][0].as_py())
        for name, values in zip(("siblings", "sides"), zip(*found)):
            nodes = nodes.set_column(nodes.schema.get_field_index(name), name, pa.array(values, pa.string()))
        top = message["top"][0].as_py()
        nodes = nodes.set_column(nodes.schema.get_field_index("top"), "top", pa.array([top] * len(nodes), pa.string()))
        yield from nodes.combine_chunks().to_batches()


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "place")


def _rise(nodes: DataFrame) -> DataFrame:
    """The nodes one round up: one per block."""
    rows = nodes.select("grp", F.expr(f"place div {RUN}").alias("block"), "place", "total", "digest")
    return _dealt(rows).mapInArrow(_up, "grp string, place long, total long, digest string")


def _fall(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """``nodes`` with siblings, sides and top, delivered from the round above (``grp, place, siblings, sides, top``)."""
    null = F.lit(None)
    rows = nodes.select("grp", F.expr(f"place div {RUN}").alias("block"), "place", "total", "digest",
                        null.cast("string").alias("siblings"), null.cast("string").alias("sides"), null.cast("string").alias("top"), "row")
    messages = above.select("grp", F.col("place").alias("block"), F.lit(-1).cast("long").alias("place"), null.cast("long").alias("total"),
                            null.cast("string").alias("digest"), "siblings", "sides", "top", null.cast(rows.schema["row"].dataType).alias("row"))
    return _dealt(rows.union(messages)).mapInArrow(_down, rows.schema)


def _placed(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` (``grp, key, digest, salt, row``) with their place in the group and its total.

    Rows are laid out by range, so a large group stands in many partitions;
    counts per group and partition (one row each) give the places.
    """
    order = [F.col(c).asc_nulls_first() for c in ("grp", "key", "digest", "salt")]
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    laid = scratch.write(laid.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "laid")
    by_group = Window.partitionBy("grp")
    n_before = F.sum("n").over(by_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = laid.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    starts = starts.select(F.col("grp").alias("grp_"), F.col("part").alias("part_"), "first",
                           F.coalesce(n_before, F.lit(0)).alias("before"), F.sum("n").over(by_group).alias("total"))
    joined = laid.join(starts, F.col("grp").eqNullSafe(F.col("grp_")) & (F.col("part") == F.col("part_")))
    placed = scratch.write(joined.select("grp", (F.col("before") + F.col("at") - F.col("first")).alias("place"), "total", "digest", "row"), "placed")
    scratch.drop(laid)
    return placed


def _rounds(leaves: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """The nodes of all rounds, from the leaves to one node per group."""
    most = leaves.agg(F.max("total")).first()[0] or 0        # one number
    rounds = [leaves]
    while most > 1:
        rounds.append(scratch.write(_rise(rounds[-1]), "nodes"))
        most = -(-most // RUN)
    return rounds


def _proofs(rounds: list[DataFrame], above: DataFrame, scratch: Scratch) -> DataFrame:
    """Leaves with their proofs, given those of each group's root (``grp, siblings, sides, top``)."""
    down = above.withColumn("place", F.lit(0).cast("long"))
    for nodes in rounds[-2:0:-1]:
        down = scratch.write(_fall(nodes.withColumn("row", F.lit(None).cast("string")), down), "suffixes")
    return _fall(rounds[0], down)


def manifest(docs: DataFrame, fields=("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang",
             key: str = "doc_id", also: dict[str, Column] | None = None) -> DataFrame:
    """Leaf, roots and inclusion proof of every row.

    Returns ``key`` (under its own name), ``grp``, ``place`` (from 0 in its
    group), ``leaf``, ``subroot``, ``root``, ``siblings`` (the digests beside
    the path to the root, one after another, from the leaf up) and ``sides``
    (``L``, ``R`` or, where the path's node is alone, ``-`` for each level),
    and the columns ``also`` computed from a row.  Null fields hash as ``-``;
    a null group is a group of its own and stands first, null keys stand first
    in their group; equal keys are ordered by leaf; repeated rows are leaves
    of their own; texts are hashed whole; other columns are ignored; an empty
    table has no leaves.  A group of one leaf has that leaf as its root.
    """
    scratch = Scratch(docs.sparkSession, "manifest")
    kept = [F.col(key).alias("key"), *[c.alias(f"also_{n}") for n, c in (also or {}).items()]]
    leaves = scratch.write(docs.select(F.col(group).cast("string").alias("grp"), F.col(key).alias("key"), leaf_digest(*fields).alias("digest"),
                                       F.monotonically_increasing_id().alias("salt"), F.struct(*kept).alias("row")), "leaves")
    rounds = _rounds(_placed(leaves, scratch), scratch)
    scratch.drop(leaves)
    tops = rounds[-1].where("place = 0").select(F.lit("").alias("grp"), F.col("grp").alias("key"), "digest", F.lit(0).cast("long").alias("salt"),
                                                F.struct(F.col("grp").alias("name")).alias("row"))
    crown = _rounds(_placed(tops, scratch), scratch)
    root = crown[-1].first()                                 # one row
    first = docs.sparkSession.createDataFrame([("", "", "", "")], "grp string, siblings string, sides string, top string")
    groups = _proofs(crown, first, scratch)
    groups = groups.select(F.col("row.name").alias("grp"), "siblings", "sides", F.col("digest").alias("top"))
    found = _proofs(rounds, scratch.write(groups, "groups"), scratch)
    return found.select(F.col("row.key").alias(key), "grp", "place", F.col("digest").alias("leaf"), F.col("top").alias("subroot"),
                        F.lit(root["digest"] if root else None).cast("string").alias("root"), "siblings", "sides",
                        *[F.col(f"row.also_{n}").alias(n) for n in (also or {})])


def fold(leaf: str, siblings: str = "siblings", sides: str = "sides") -> Column:
    """The root that a leaf digest and its proof give."""
    def step(acc, level):
        side, beside = F.substring(F.col(sides), level, 1), F.substring(F.col(siblings), acc["used"] + 1, 64)
        pair = F.when(side == "L", F.concat(beside, acc["digest"])).when(side == "R", F.concat(acc["digest"], beside)).otherwise(acc["digest"])
        return F.struct(F.sha2(pair, 256).alias("digest"), (acc["used"] + F.when(side == "-", 0).otherwise(64)).alias("used"))

    levels = F.sequence(F.lit(1), F.length(sides))
    start = F.struct(F.col(leaf).alias("digest"), F.lit(0).alias("used"))
    folded = F.aggregate(levels, start, step, lambda acc: acc["digest"])
    return F.when(F.length(sides) > 0, folded).otherwise(F.col(leaf))
