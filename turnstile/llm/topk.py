"""Exact inner-product top-k over norm buckets.

Vectors are ordered by length and cut into buckets, queries into blocks.  A
first pass against the bucket of the longest vectors gives every query a
threshold, the k-th best product so far.  With the bucket's longest length
``l``, the local cosine threshold of a query is ``t = threshold / (|q| l)``:

* ``t > 1``: no vector of the bucket can win; the bucket is skipped.
* ``t`` is large: coordinate pruning.  With ``cos a`` and ``cos b`` the unit
  query's and unit vector's value of a coordinate, a cosine of ``t`` or more
  needs ``|a - b| <= arccos t``; the query's largest coordinates give ranges
  that a vector must meet.
* else: length pruning, by ``|v| >= threshold / |q|``.

What remains is verified with exact integer products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstile.llm.scratch import Scratch
from turnstile.llm.vectors import matrix, usable

BUCKET = 4096           # vectors of a bucket
GROUP = 16              # neighbouring buckets that a task goes through
QUERIES = 512           # queries of a block
COORDINATES = 5
COORDINATE_FROM = 0.3   # local cosine threshold from which coordinates prune better than lengths


def _blobs(rows_per_blob: int):
    """Rows of a partition, in order, as blobs of equal dimension."""
    def run(batches):
        at = TaskContext.get().partitionId() << 24
        held, ids, dim = [], [], None

        def blob():
            m = np.concatenate(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([at]), pa.array([dim], pa.int32()), pa.array([np.concatenate(ids).astype("<i8").tobytes()]),
                 pa.array([np.ascontiguousarray(m, "<i8").tobytes()])], names=["blob", "dim", "ids", "vectors"])

        for b in batches:
            sizes = b.column("dim").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1), len(sizes)] if len(sizes) else []
            for i, j in zip(cuts[:-1], cuts[1:]):
                while i < j:
                    if held and (dim != sizes[i] or sum(map(len, ids)) >= rows_per_blob):
                        yield blob()
                        held, ids, at = [], [], at + 1
                    dim = int(sizes[i])
                    n = min(j - i, rows_per_blob - sum(map(len, ids)))
                    held.append(matrix(b.column("vector").slice(i, n)))
                    ids.append(b.column("id").slice(i, n).to_numpy())
                    i += n
        if held:
            yield blob()
    return run


def _open(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<i8").reshape(-1, dim)


def _products(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact products; Python integers where 64 bits might not hold them."""
    if len(m) and float(np.abs(m).max()) * float(np.abs(q).max()) * m.shape[1] >= 2.0 ** 62:
        return m.astype(object) @ q.astype(object)
    return m @ q


def _candidates(unit_t: np.ndarray, lengths: np.ndarray, q: np.ndarray, q_len: float, threshold: float) -> np.ndarray:
    """Rows of a bucket whose product with ``q`` can reach the threshold."""
    if q_len == 0 or threshold <= 0 or lengths.max() == 0:
        return np.arange(len(lengths))
    local = threshold / (q_len * lengths.max()) * (1 - 1e-9)
    if local > 1:
        return np.zeros(0, np.int64)
    if local < COORDINATE_FROM:
        return np.flatnonzero(lengths >= threshold / q_len * (1 - 1e-9))
    unit = q / q_len
    focus = np.argsort(-np.abs(unit), kind="stable")[:COORDINATES]
    spread = np.arccos(local)
    keep = np.ones(len(lengths), bool)
    for f in focus:
        angle = np.arccos(np.clip(unit[f], -1, 1))
        keep &= unit_t[f] >= np.cos(min(np.pi, angle + spread)) - 1e-9
        keep &= unit_t[f] <= np.cos(max(0.0, angle - spread)) + 1e-9
    return np.flatnonzero(keep)


def _best(scores, ids, k):
    """Positions of the k best: largest score, then smallest id."""
    if len(scores) > 4 * k and scores.dtype != object:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= cut)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    order = sorted(range(len(scores)), key=lambda i: (-int(scores[i]), int(ids[i])))
    return np.array(order[:k], np.int64)


def _search(k: int):
    def run(buckets: pa.Table, blocks: pa.Table) -> pa.Table:
        out = [[], [], []]
        held = []
        for b in buckets.sort_by("blob").to_pylist():
            ids, m = _open(b["ids"], b["vectors"], b["dim"])
            lengths = np.sqrt((m.astype(float) ** 2).sum(1))
            held.append((ids, m, lengths, np.ascontiguousarray((m / np.maximum(lengths, 1e-300)[:, None]).T)))
        for block in blocks.to_pylist():
            q_ids, qs = _open(block["ids"], block["vectors"], block["dim"])
            start = np.frombuffer(block["thresholds"], "<f8")
            for q_id, q, threshold in zip(q_ids, qs, start):
                q_len = float(np.sqrt((q.astype(float) ** 2).sum()))
                best_s, best_i = np.zeros(0, np.int64), np.zeros(0, np.int64)
                for ids, m, lengths, unit_t in held:
                    rows = _candidates(unit_t, lengths, q, q_len, threshold)
                    rows = rows[ids[rows] != q_id]
                    if not len(rows):
                        continue
                    s = np.concatenate([best_s, _products(m[rows], q)])
                    i = np.concatenate([best_i, ids[rows]])
                    top = _best(s, i, k)
                    best_s, best_i = s[top], i[top]
                    if len(best_s) == k:
                        threshold = max(threshold, float(best_s[-1]))
                out[0] += [int(q_id)] * len(best_i)
                out[1] += best_i.tolist()
                out[2] += [int(x) for x in best_s]
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()),
                         "score": pa.array(out[2], pa.int64())})
    return run


def _thresholds(k: int):
    """First pass: the k-th best product of each query in the given bucket."""
    search = _search(k)

    def run(buckets: pa.Table, blocks: pa.Table) -> pa.Table:
        out = {n: [] for n in ("blob", "dim", "ids", "vectors", "thresholds")}
        for block in blocks.to_pylist():
            q_ids = np.frombuffer(block["ids"], "<i8")
            none = np.full(len(q_ids), -np.inf).astype("<f8").tobytes()
            cut = dict.fromkeys(q_ids.tolist(), [])
            if buckets.num_rows:
                one = pa.Table.from_pylist([block | {"thresholds": none}])
                got = search(buckets, one)
                for q, s in zip(got.column("query_id").to_pylist(), got.column("score").to_pylist()):
                    cut[q] = [*cut[q], s]
            # rows that repeat a query's id share its k places, so the k-th best of them all is a bound too
            least = [float(sorted(cut[q])[-k]) if len(cut[q]) >= k else -np.inf for q in q_ids.tolist()]
            for n in out:
                out[n].append(np.array(least, "<f8").tobytes() if n == "thresholds" else block[n])
        return pa.table(out, schema=pa.schema([("blob", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()),
                                               ("vectors", pa.binary()), ("thresholds", pa.binary())]))
    return run


_BLOB = "blob long, dim int, ids binary, vectors binary"


def integer_vectors(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``id, vector`` with the components ``floor(scale * x)`` as integers."""
    rows = usable(vectors, id_col, vector_col, "double")
    return rows.select("id", F.transform("vector", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("vector"))


def top_products(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id",
                 vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest integer inner products.

    ``is_query`` is a condition on column ``id``.  Candidates are all rows of
    other ids, ties go to the smaller id, and fewer than ``k`` candidates are
    all returned.  Rows with a null id, a null or empty vector or a null or
    non-finite component take no part.  Rows that repeat an id are all
    candidates, each on its own; as queries they share the ``k`` places of
    their id, which hold the best products of any of them.  Only vectors of
    equal dimension are compared; zero vectors score 0.  Other columns are ignored; an empty
    table gives none.  A task holds one group of buckets and one query block.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    rows = integer_vectors(vectors, scale, id_col, vector_col)
    rows = rows.withColumn("dim", F.size("vector")).withColumn(
        "length", F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = scratch.write(rows, "rows")
    n = rows.count()
    parts = max(1, -(-n // (BUCKET * GROUP)))
    ordered = rows.repartitionByRange(parts, "dim", F.desc("length"), "id").sortWithinPartitions("dim", F.desc("length"), "id")
    buckets = scratch.write(ordered.select("id", "vector", "dim").mapInArrow(_blobs(BUCKET), _BLOB), "buckets")
    asked = rows.where(is_query).repartitionByRange(max(1, n // (BUCKET * GROUP * 8)), "dim", "id").sortWithinPartitions("dim", "id")
    blocks = scratch.write(asked.select("id", "vector", "dim").mapInArrow(_blobs(QUERIES), _BLOB), "blocks")

    # one bucket of each dimension, against every query block
    first = buckets.groupBy("dim").agg(F.min("blob").alias("blob"))
    pairs = blocks.select(F.col("blob").alias("block"), "dim")
    longest = buckets.join(first, ["dim", "blob"]).join(pairs, "dim")
    blocks = (longest.groupBy("block").cogroup(blocks.withColumn("block", F.col("blob")).groupBy("block"))
              .applyInArrow(_thresholds(k), _BLOB + ", thresholds binary"))
    blocks = scratch.write(blocks, "thresholds")

    groups = buckets.select("dim", F.expr(f"blob div {GROUP}").alias("bucket_group")).distinct()
    tasks = groups.join(pairs, "dim")
    left = buckets.withColumn("bucket_group", F.expr(f"blob div {GROUP}")).join(tasks, ["dim", "bucket_group"])
    right = blocks.withColumnRenamed("blob", "block").join(tasks, ["dim", "block"])
    found = (left.groupBy("bucket_group", "dim", "block").cogroup(right.groupBy("bucket_group", "dim", "block"))
             .applyInArrow(_search(k), "query_id long, vec_id long, score long"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
