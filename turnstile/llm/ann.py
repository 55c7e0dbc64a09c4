"""Approximate nearest neighbours: NN-descent graph and greedy graph search.

Nearness is the inner product.  A vector ``x`` counts as extended by
``sqrt(M^2 - |x|^2)`` (``M`` the largest length), which makes nearness among
the extended vectors a distance; a query is extended by 0 and keeps its inner
products.  That distance is computed from the vectors themselves, so that one
long vector takes no precision from the others.  Equal vectors form one node, so that copies neither fill a
neighbour list nor a task.

The graph starts from vectors that are close in a few random orders, and
improves by NN-descent: each node introduces its neighbours and the nodes
that name it to each other, and each keeps its best.  A query walks the
graph from its entry nodes, always expanding the best nodes not expanded yet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstile.llm.scratch import Scratch
from turnstile.llm.vectors import matrix, usable

DEGREE = 32            # neighbours kept for a node
INTRODUCED = 24        # forward and as many reverse neighbours that a node introduces to each other
TREES = 8              # random orders
LEAF = 4096            # vectors compared with each other in an order
BITS = 20              # hyperplanes of an order
SETTLED = 0.01         # stop when a smaller share of the graph's edges is new
BEAM = 96              # best nodes a query keeps
EXPAND = 32            # nodes a query expands in a step
_EDGE = "u long, v long, near double"


def _orders(dim: int, seed: int):
    """Sort keys of each vector: signs at random hyperplanes, then a projection."""
    def run(batches):
        rng = np.random.default_rng(seed)
        planes = rng.standard_normal((TREES, dim, BITS + 1)).astype(np.float32)
        for b in batches:
            if b.num_rows == 0:
                continue
            m = matrix(b.column("x"))
            m = m / np.maximum(np.abs(m).max(1, keepdims=True), np.float32(1e-30))   # an order is one of directions
            for t in range(TREES):
                p = m @ planes[t]
                code = (p[:, :BITS] > 0) @ (1 << np.arange(BITS, dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(m), t, np.int32)), pa.array(code), pa.array(p[:, BITS].astype(float)), *b.columns],
                    names=["tree", "code", "along", "id", "x"])
    return run


def _leaf_edges(largest: float):
    """Each LEAF consecutive vectors of a partition: the DEGREE nearest of each."""
    def run(batches):
        ids, xs, tree = [], [], None

        def edges():
            v, m = np.concatenate(ids), np.concatenate(xs)
            return _nearest_among(v, m, DEGREE, largest)

        for b in batches:
            trees = b.column("tree").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(trees)) + 1), len(trees)] if len(trees) else []
            for i, j in zip(cuts[:-1], cuts[1:]):
                while i < j:
                    if ids and (tree != trees[i] or sum(map(len, ids)) >= LEAF):
                        yield edges()
                        ids, xs = [], []
                    tree = trees[i]
                    n = min(j - i, LEAF - sum(map(len, ids)))
                    ids.append(b.column("id").slice(i, n).to_numpy())
                    xs.append(matrix(b.column("x").slice(i, n)))
                    i += n
        if ids:
            yield edges()
    return run


def _nearest_among(v: np.ndarray, m: np.ndarray, k: int, largest: float, least: np.ndarray | None = None) -> pa.RecordBatch:
    """Edges from each of some vectors to its nearest others (nearer than ``least``).

    ``near`` is minus half the squared distance of the extended vectors.
    """
    k = min(k, len(v))
    m = m.astype(float)
    square = (m ** 2).sum(1)
    rest = np.sqrt(np.maximum(0, largest ** 2 - square))
    out = [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
    for i in range(0, len(v), 512):
        own = v[i:i + 512]
        a, r = square[i:i + 512, None], rest[i:i + 512, None]
        near = m[i:i + 512] @ m.T - (a + square) / 2 - ((a - square) / np.maximum(r + rest, 1e-30)) ** 2 / 2
        near[own[:, None] == v[None, :]] = -np.inf
        if least is not None:
            near[near <= least[i:i + 512, None]] = -np.inf
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        values = np.take_along_axis(near, top, 1).astype(float)
        good = values > -np.inf
        for n, x in enumerate((np.repeat(own, good.sum(1)), v[top][good], values[good])):
            out[n] = np.concatenate([out[n], x])
    return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["u", "v", "near"])


def _packed(batches):
    """Vectors as bytes."""
    for b in batches:
        rows = [r.tobytes() for r in matrix(b.column("x"))] if b.num_rows else []
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(rows, pa.binary())], names=["id", "x"])


def _introduce(largest: float):
    """The nodes around one node, compared with each other."""
    def run(group: pa.Table) -> pa.Table:
        v = group.column("v").to_numpy()
        raw = b"".join(group.column("x").to_pylist())
        m = np.frombuffer(raw, np.float32).reshape(len(v), -1)
        return pa.Table.from_batches([_nearest_among(v, m, DEGREE, largest, group.column("least").to_numpy())])
    return run


def _strongest(edges: DataFrame, per: str, k: int) -> DataFrame:
    order = Window.partitionBy(per).orderBy(F.desc("near"), "u", "v")
    return edges.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def build(nodes: DataFrame, largest: float, scratch: Scratch, seed: int = 7) -> DataFrame:
    """Neighbour graph ``u, v, near`` of ``nodes(id, x)``; ``largest`` is the largest length."""
    one = nodes.select(F.size("x").alias("n")).first()
    if one is None:
        return nodes.sparkSession.createDataFrame([], _EDGE)
    keyed = nodes.mapInArrow(_orders(one["n"], seed), "tree int, code long, along double, id long, x array<float>")
    sorted_rows = keyed.repartitionByRange("tree", "code", "along", "id").sortWithinPartitions("tree", "code", "along", "id")
    first = sorted_rows.mapInArrow(_leaf_edges(largest), _EDGE)
    packed = scratch.write(nodes.mapInArrow(_packed, "id long, x binary"), "packed")
    first = first.groupBy("u", "v").agg(F.max("near").alias("near"))      # orders may differ in the last bits
    graph = scratch.write(_strongest(first, "u", DEGREE), "graph")
    size = graph.count()
    fresh = graph
    while True:            # edges only get nearer, so the rounds end
        changed = fresh.select(F.col("u").alias("of")).union(fresh.select(F.col("v").alias("of"))).distinct()
        forward = _strongest(graph, "u", INTRODUCED).select("u", "v")
        back = _strongest(graph, "v", INTRODUCED).select(F.col("v").alias("u"), F.col("u").alias("v"))
        around = forward.union(back).distinct().join(changed.withColumnRenamed("of", "u"), "u", "left_semi")
        least = graph.groupBy("u").agg(F.min("near").alias("least"), F.count("*").alias("n")).select(
            F.col("u").alias("id"), F.when(F.col("n") == DEGREE, F.col("least")).alias("least"))
        known = packed.join(least, "id", "left").select(F.col("id").alias("v"), "x", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
        met = around.join(known, "v").select("u", "v", "x", "least").groupBy("u").applyInArrow(_introduce(largest), _EDGE)
        best = met.groupBy("u", "v").agg(F.max("near").alias("near"))
        best = scratch.write(best.join(graph, ["u", "v"], "left_anti"), "met")
        better = scratch.write(_strongest(graph.withColumn("new", F.lit(False)).union(best.withColumn("new", F.lit(True))), "u", DEGREE), "graph")
        graph, fresh = better.select("u", "v", "near"), better.where("new").select("u", "v")
        n_new = fresh.count()
        scratch.drop(best)
        if n_new <= SETTLED * size:
            break
    return graph


def both_ways(graph: DataFrame) -> DataFrame:
    """Ways ``u, v`` of a walk: a node's neighbours, and the DEGREE nearest of those that name it.

    A node that no other holds for near (a very long vector, say) is reached from its own neighbours.
    """
    back = _strongest(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "near"), "u", DEGREE)
    return graph.select("u", "v").union(back.select("u", "v")).distinct()


def _score(batches):
    for b in batches:
        if b.num_rows:
            near = np.einsum("ij,ij->i", matrix(b.column("q")).astype(float), matrix(b.column("vector")).astype(float))
            yield pa.RecordBatch.from_arrays([b.column("query"), b.column("node"), pa.array(near)], names=["query", "node", "score"])


def search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, entries: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """Greedy search: ``query, node, score`` of the best nodes found.

    ``graph(u, v)``, ``nodes(id, vector)``, ``queries(query, q)``, ``entries(query, node)``.
    In each step a query expands its EXPAND best nodes that it has not
    expanded, of its best BEAM; it stops when there are none.
    """
    schema = "query long, node long, score double"

    def scored(pairs):
        rows = pairs.join(nodes.select(F.col("id").alias("node"), "vector"), "node").join(queries, "query")
        return rows.select("query", "node", "q", "vector").mapInArrow(_score, schema)

    best = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    beam = scratch.write(scored(entries.distinct()).withColumn("expanded", F.lit(False)), "beam")
    while True:            # a beam only gets better, so the walk ends
        top = beam.withColumn("place", F.row_number().over(best)).where(F.col("place") <= max(BEAM, k)).drop("place")
        todo = top.where(~F.col("expanded"))
        todo = todo.withColumn("place", F.row_number().over(best)).where(F.col("place") <= EXPAND).select("query", "node")
        todo = scratch.write(todo, "todo")
        if todo.isEmpty():
            break
        reached = todo.join(graph, F.col("node") == F.col("u")).select("query", F.col("v").alias("node")).distinct()
        fresh = scored(reached.join(beam, ["query", "node"], "left_anti"))
        marked = top.join(todo.withColumn("now", F.lit(True)), ["query", "node"], "left").select(
            "query", "node", "score", (F.col("expanded") | F.coalesce("now", F.lit(False))).alias("expanded"))
        grown = scratch.write(marked.union(fresh.withColumn("expanded", F.lit(False))), "beam")
        scratch.drop(beam, todo)
        beam = grown
    return beam.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("query", "node", "score")


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest found.

    ``is_query`` is a condition on column ``id``.  All usable rows are indexed
    and are candidates, but for those of the query's own id.  Score is the
    inner product in double precision; ties go to the smaller id.  Rows with a
    null id, or a vector that is null, empty, zero or holds a null or
    non-finite component, take no part.  Rows that repeat an id and its vector
    count once; rows that repeat an id with other vectors are all candidates,
    and as queries share the ``k`` places of their id.  Vectors are searched
    among those of their own dimension, in a graph for each dimension.  Other
    columns are ignored; an empty table gives none.
    """
    scratch = Scratch(vectors.sparkSession, "ann")
    rows = usable(vectors, id_col, vector_col, "float").where(F.exists("vector", lambda x: x != 0)).distinct()
    rows = scratch.write(rows.withColumn("dim", F.size("vector")), "rows")
    found = rows.select(F.col("id").alias("query_id"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).where(F.lit(False))
    for r in rows.groupBy("dim").count().orderBy("dim").collect():          # one row per dimension
        found = found.union(_nearest_of_one_dimension(rows.where(F.col("dim") == r["dim"]).drop("dim"), is_query, k, scratch))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nearest_of_one_dimension(rows: DataFrame, is_query, k: int, scratch: Scratch) -> DataFrame:
    """``query_id, vec_id, score`` of at least the ``k`` nearest found, among vectors of one dimension."""
    # a node for each distinct vector, numbered as written; only its k + 1 smallest ids can be in a result
    member = Window.partitionBy("vector").orderBy("id")
    firsts = rows.withColumn("place", F.row_number().over(member)).where(F.col("place") <= k + 1)
    nodes = scratch.write(rows.select("vector").distinct().select(F.monotonically_increasing_id().alias("id"), "vector"), "nodes")
    classes = nodes.withColumnRenamed("id", "node")
    members = scratch.write(firsts.join(classes, "vector").select("node", "id"), "members")
    largest = nodes.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()[0] ** 0.5
    graph = scratch.write(both_ways(build(nodes.select("id", F.col("vector").alias("x")), largest, scratch)), "ways")
    # rows of the query's own id are left out at the end: one, or more where ids repeat (a beam holds no more than BEAM)
    own = min(BEAM, rows.groupBy("id").count().agg(F.max("count")).first()[0])

    # queries with equal vectors walk together; they enter at their own node
    asked = rows.where(is_query).join(classes, "vector").select(F.col("id").alias("query_id"), F.col("node").alias("query"))
    asked = scratch.write(asked, "asked")
    walks = asked.select("query").distinct()
    queries = scratch.write(walks.join(nodes, F.col("query") == F.col("id")).select("query", F.col("vector").alias("q")), "queries")
    found = scratch.write(search(graph, nodes, queries, walks.select("query", F.col("query").alias("node")), scratch, k + own), "found")
    found = found.join(members, "node").select("query", F.col("id").alias("vec_id"), "score")
    place = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k + own).drop("place")
    return asked.join(found, "query").where(F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", "score")
