"""Packing token sequences by non-negative least squares over a histogram.

Documents are cut into full windows and one shorter rest.  The counts of the
rest lengths form a histogram with at most one entry per length, so the plan
is a problem of fixed size at any number of documents: combinations of up to
three lengths that fill the window are the columns, their repeat counts are
solved by non-negative least squares, rounded, and the lengths left over are
packed greedily.  Pieces find their place by their rank within their length.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstile.llm import bpe
from turnstile.llm import textarrays as ta
from turnstile.llm.scratch import Scratch

SPLIT_BYTES = 16 << 20  # text split and numbered at once; a longer document stands alone
CUT_BYTES = 4 << 20     # text whose ids are laid out at once
RANK_ROWS = 1000        # rows ranked together
RANK_GROUPS = 100_000   # groups of a length at most: larger inputs rank more rows together


def _pieces(path, window, end_id, keep_ids):
    def run(batches):
        for b in batches:
            ids = b.column(0)
            _, offs = ta.text_buffer(b.column(1))
            block = bpe.Block(path)
            done = 0
            start = size = values = np.zeros(0, np.int64)
            for i, j in ta.chunks(offs, SPLIT_BYTES):
                block.add(b.column(1).slice(i, j - i))
                pos, n_words = block.positions()
                block.stream, block.lengths = [], []
                fresh = list(itertools.islice(reversed(block.words), len(block.words) - done))[::-1]
                done += len(fresh)
                coded, n = bpe.encode_words(fresh, path)
                start = np.concatenate([start, len(values) + np.cumsum(n) - n])
                size = np.concatenate([size, n])
                values = np.concatenate([values, coded])
                edge = np.concatenate([[0], np.cumsum(n_words)])
                for k, m in ta.chunks(offs[i:j + 1] - offs[i], CUT_BYTES):
                    yield _cut(ids.slice(i + k, m - k), pos[edge[k]:edge[m]], n_words[k:m], start, size, values, window, end_id, keep_ids)
    return ta.tidy(run)


def _cut(ids, pos, n_words, start, size, values, window, end_id, keep_ids):
    tokens, n = bpe.spread(values, start[pos], size[pos])
    total = np.concatenate([[0], np.cumsum(n)])
    ends = total[np.cumsum(n_words)]
    tokens = np.insert(tokens, ends, end_id).astype("<u4")
    ends = ends + np.arange(1, len(ends) + 1)
    begins = np.concatenate([[0], ends[:-1]])
    counts = ends - begins
    n_pieces = -(-counts // window)
    row = np.repeat(np.arange(len(counts)), n_pieces)
    at = (np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)) * window
    length = np.minimum(window, counts[row] - at)
    raw, a = tokens.tobytes(), (begins[row] + at) * 4
    spans = list(zip(a.tolist(), (a + length * 4).tolist()))
    columns = [ids.take(pa.array(row)), pa.array(at), pa.array(length),
               pa.array([zlib.crc32(raw[p:q]) for p, q in spans], pa.int64()), pa.array(counts[row])]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    if keep_ids:
        columns.append(pa.array([raw[p:q] for p, q in spans], pa.binary()))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names=names)


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Multisets of up to three of the lengths that fill the window; 0 marks an unused place."""
    has = np.zeros(window + 1, bool)
    has[lengths] = True
    out = [np.array([[window, 0, 0]])] if has[window] else []
    two = lengths[(lengths * 2 <= window) & has[window - lengths]]
    out.append(np.stack([two, window - two, np.zeros_like(two)], 1))
    a, b = np.meshgrid(lengths, lengths, indexing="ij")
    c = window - a - b
    fits = (a <= b) & (b <= c)
    a, b, c = a[fits], b[fits], c[fits]
    out.append(np.stack([a, b, c], 1)[has[c]])
    return np.concatenate(out)


def least_squares(combos: np.ndarray, target: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative repeat counts ``x`` that make the use of lengths come near ``target``.

    Accelerated projected gradient; each length is weighted by its count, so
    rare lengths are met as closely as frequent ones.
    """
    weight = 1 / np.sqrt(np.maximum(target, 1.0))
    weight[0] = 0
    goal = target * weight

    def use(x):
        total = np.zeros(len(target))
        for k in range(combos.shape[1]):
            total += np.bincount(combos[:, k], weights=x, minlength=len(target))
        return total * weight

    def back(r):
        r = r * weight
        return r[combos].sum(1)

    v = np.ones(len(combos))
    for _ in range(12):
        v = back(use(v))
        v /= max(np.linalg.norm(v), 1e-300)
    step = 1 / max(v @ back(use(v)), 1e-12) / 1.05
    x = z = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, z - step * back(use(z) - goal))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def plan(counts: dict[int, int], window: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is laid out; every piece is used once."""
    left = np.zeros(window + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    patterns = []
    lengths = np.flatnonzero(left)
    if len(lengths) == 0:
        return patterns
    if left[window]:
        patterns.append(((window,), int(left[window])))
        left[window] = 0
        lengths = lengths[:-1]
    combos = combinations(lengths, window)
    if len(combos):
        x = least_squares(combos, left.astype(float))
        for k in np.argsort(-x, kind="stable"):
            want = int(np.floor(x[k] + 0.5))
            if want == 0:
                break
            shape = [int(c) for c in combos[k] if c]
            n = min(want, *(int(left[c]) // shape.count(c) for c in set(shape)))
            if n > 0:
                patterns.append((tuple(shape), n))
                for c in shape:
                    left[c] -= n
    while left.any():                       # greedy: the longest piece, then the longest that still fit
        room, shape, spare = window, [], left.copy()
        while room:
            fit = np.flatnonzero(spare[1:room + 1])
            if not len(fit):
                break
            c = int(fit[-1]) + 1
            shape.append(c)
            spare[c] -= 1
            room -= c
        n = min(int(left[c]) // shape.count(c) for c in set(shape))
        patterns.append((tuple(shape), n))
        for c in shape:
            left[c] -= n
    return patterns


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length, runs of ranks and where they go: sorted by (length, first rank)."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for shape, n in patterns:
        offset = 0
        for c in shape:
            rows.append((c, taken.get(c, 0), sequence, offset))
            taken[c] = taken.get(c, 0) + n
            offset += c
        sequence += n
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4).T
    return dict(zip(("length", "rank", "sequence", "offset"), cols))


def _lay_out(places):
    def run(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            lo = np.searchsorted(places["length"], length, "left")
            hi = np.searchsorted(places["length"], length, "right")
            while (lo < hi - 1).any():                # last run of the length that starts at or before the rank
                mid = (lo + hi) // 2
                below = places["rank"][np.minimum(mid, len(places["rank"]) - 1)] <= rank
                go = lo < hi - 1
                lo, hi = np.where(go & below, mid, lo), np.where(go & ~below, mid, hi)
            columns = {n: b.column(n) for n in b.schema.names if n != "rank"}
            columns["sequence_id"] = pa.array(places["sequence"][lo] + rank - places["rank"][lo])
            columns["offset"] = pa.array(places["offset"][lo])
            yield pa.RecordBatch.from_pydict(columns)
    return run


def pack(docs: DataFrame, path: str, window: int = 1024, end_id: int = 0, keep_ids: bool = False,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Places of all pieces of all documents in sequences of at most ``window`` ids.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset`` and, with ``keep_ids``, the piece's ``ids`` (little-endian
    unsigned 32-bit).  A document is its ids and ``end_id``; a null or empty
    text is that one id.  It is cut only at multiples of the window.  Repeated
    rows are packed as often as they occur, rows with a null id too; other
    columns are ignored; an empty table gives an empty result.  Only the
    histogram of lengths (``window`` numbers) reaches the driver.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids
    pieces = scratch.write(texts.mapInArrow(_pieces(path, window, end_id, keep_ids), schema), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = _places(plan(counts, window))

    groups = max(1, min(RANK_GROUPS, sum(counts.values()) // RANK_ROWS))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    sizes = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = sizes.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = dealt.withColumn("within", within).join(before, ["length", "part"])
    ranked = ranked.select(*pieces.columns, (F.col("before") + F.col("within")).alias("rank"))
    return ranked.mapInArrow(_lay_out(places), schema + ", sequence_id long, offset long")
