"""Language-model scoring with a Katz backoff bigram model.

Counts are Good-Turing discounted and the mass taken from the words seen
after a history is given to the others in proportion to their unigram
probability, with a weight that makes the sum over the vocabulary and one
unknown word exactly 1:

    P(w | h) = d(c(h, w)) c(h, w) / c(h)                    if c(h, w) > 0
             = a(h) P(w),   a(h) = (1 - sum seen P(. | h)) / (1 - sum seen P(.))
    P(w)     = d(c(w)) c(w) / N,   P(unknown) = 1 - sum P(w)

Counting and scoring share one data flow.  Documents of a batch form blocks; a block
sends each distinct word once to the partition of the word (unigram
table), and each distinct pair of words once to the partition of its history
(bigram table), as packed arrays; the counts return to the block, which
scores its documents.  Histories with more than 1/10,000 of all tokens are
split over several partitions by the second word; there are at most 10,000.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstile.llm import textarrays as ta
from turnstile.llm.scratch import Scratch

GT_K = 5                     # counts above it lose TAIL each, so that every history keeps some mass
TAIL = 0.1
HOT_SHARE = 10_000
BLOCK_BYTES = 12 << 20       # text of a block; a longer document is a block of its own
PART_TOKENS = 1_000_000      # training tokens of a history partition
END = np.uint64(0x5F656E645F)
START = -1
PAIRS_AT_ONCE = 1 << 18      # pairs, or tokens of whole documents, that one step of a block computes with


def dump(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; integers byte plane by byte plane."""
    out = [struct.pack("<H", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if a.size else b""
        body = zstandard.compress(planes, 3)
        out += [struct.pack("<2sI", a.dtype.str[1:].encode(), len(body)), body]
    return b"".join(out)


def load(raw: bytes) -> list[np.ndarray]:
    n, at, out = struct.unpack_from("<H", raw)[0], 2, []
    for _ in range(n):
        kind, size = struct.unpack_from("<2sI", raw, at)
        at += 6
        body = zstandard.decompress(raw[at:at + size])
        at += size
        dtype = np.dtype("<" + kind.decode())
        planes = np.frombuffer(body, np.uint8).reshape(dtype.itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).view(dtype).ravel())
    return out


def discounts(n: np.ndarray) -> np.ndarray:
    """Factors d(0..GT_K) from counts of counts ``n[0..GT_K+1]``; absolute discounts where they don't hold."""
    d = np.ones(GT_K + 1)
    r = np.arange(1, GT_K + 1)
    if (n[1:] > 0).all():
        last = (GT_K + 1) * n[GT_K + 1] / n[1]
        d[1:] = ((r + 1) * n[r + 1] / (n[r] * r) - last) / (1 - last) if last != 1 else -1
    else:
        d[1:] = -1
    wrong = (d[1:] <= 0) | (d[1:] >= 1)
    d[1:][wrong] = ((r - 0.5) / r)[wrong]
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Counts after discounting (0 stays 0)."""
    c = np.asarray(c, float)
    return np.where(c <= GT_K, d[np.minimum(c, GT_K).astype(int)] * c, c - TAIL) * (c > 0)


class Block:
    """Documents of a batch as positions in their sorted distinct words; every document ends with END."""

    def __init__(self, batch: pa.RecordBatch, ordinal: int):
        self.ids = batch.column(0).cast(pa.int64())
        self.train = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        data, offs = ta.text_buffer(batch.column(1))
        hashes, sizes = [], []
        for i, j in ta.chunks(offs):
            part, at = ta.lower_ascii(data[offs[i]:offs[j]]), offs[i:j + 1] - offs[i]
            s, e, rows = ta.words(part, at)
            n = np.bincount(rows, minlength=j - i)
            hashes.append(np.insert(ta.word_hashes(part, s, e), np.cumsum(n), END))
            sizes.append(n + 1)
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.words, self.flat = np.unique(flat, return_inverse=True)
        seen = self.ids.fill_null(-1).to_numpy(zero_copy_only=False).tobytes()
        place = (TaskContext.get().partitionId() << 20) + ordinal
        self.name = xxhash.xxh64_intdigest(seen, seed=place) - (1 << 63)


def _blocks(batches):
    ordinal = 0
    for b in batches:
        _, offs = ta.text_buffer(b.column(1))
        for i, j in ta.chunks(offs, BLOCK_BYTES):
            yield Block(b.slice(i, j - i), ordinal)
            ordinal += 1


def _word_rows(batches):
    for x in _blocks(batches):
        n = np.bincount(x.flat, weights=np.repeat(x.train, x.sizes), minlength=len(x.words)).astype(np.int64)
        for a in range(0, len(n), 1 << 17):
            part = slice(a, a + (1 << 17))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.words[part].view(np.int64)), pa.array(np.full(len(n[part]), x.name)),
                 pa.array(np.arange(len(n), dtype=np.int32)[part]), pa.array(n[part])], names=["w", "block", "at", "n"])


def _doc_rows(batches):
    for x in _blocks(batches):
        yield pa.RecordBatch.from_arrays(
            [pa.array([x.name]), pa.ListArray.from_arrays(pa.array([0, len(x.ids)], pa.int32()), x.ids),
             pa.array([dump(x.sizes.astype("<u4"), x.train.astype("<u1"), x.flat.astype("<u4"))])],
            names=["block", "doc_ids", "body"])


def _number(batches):
    """Rows sorted by word: numbers the words of a partition in order."""
    first, last, base = -1, None, TaskContext.get().partitionId() << 32
    for b in batches:
        w = b.column("w").to_numpy()
        if not len(w):
            continue
        new = np.concatenate([[last is None or w[0] != last], w[1:] != w[:-1]])
        number = first + np.cumsum(new)
        first, last = int(number[-1]), w[-1]
        yield pa.RecordBatch.from_arrays([b.column("block"), b.column("at"), pa.array(base + number), b.column("c"), pa.array(new)],
                                         names=["block", "at", "id", "c", "is_first"])


def _pairs(flat, sizes, train, ids, c, n_total, parts):
    """Distinct pairs of a known history and a word of a block, ordered by (partition, history, word).

    Returns the pairs' arrays (partition, history, word, training count,
    whether the history is split), each token's position among the pairs (-1
    after an unknown word), and each token's history.  Positions are 32-bit,
    and what a step needs alone is freed with it: a block's arrays decide the
    memory of a worker.
    """
    n_words = len(ids)
    starts = np.cumsum(sizes) - sizes
    history = np.empty(len(flat), np.int32)
    history[1:] = flat[:-1]
    history[starts] = n_words                                   # the start of a document
    use = np.append(c > 0, True)[history]
    code = history[use].astype(np.int64)
    code *= n_words + 1
    code += flat[use]
    by = np.argsort(code)
    code = code[by]
    new = np.ones(len(code), bool)
    new[1:] = code[1:] != code[:-1]
    code = code[new]
    token = np.empty(len(by), np.int32)                         # each token's pair
    token[by] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    del by, new
    n_train = np.bincount(token[np.repeat(train, sizes)[use]], minlength=len(code)).astype(np.int32)
    n_starts = c[flat[sizes[0] - 1]] if len(sizes) else 0       # as many as ends
    splits = 1 + np.append(c, n_starts) * HOT_SHARE // max(n_total, 1)       # of each history
    h_id = np.append(ids, START)
    part, hot = np.empty(len(code), np.int32), np.empty(len(code), bool)
    for a in range(0, len(code), PAIRS_AT_ONCE):
        s = slice(a, a + PAIRS_AT_ONCE)
        h, w = np.divmod(code[s], n_words + 1)
        salt = np.where(splits[h] > 1, ids[w] % splits[h], 0)
        mixed = ta.mix64((h_id[h].astype(np.uint64) << np.uint64(20)) + salt.astype(np.uint64))
        part[s] = (mixed >> np.uint64(11)).astype(np.int64) % parts
        hot[s] = splits[h] > 1
    order = np.argsort(part, kind="stable").astype(np.int32)                 # pairs are in order already
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    token_pair = np.full(len(flat), -1, np.int32)
    token_pair[use] = place[token]
    del place, token, use
    code = code[order]
    h = (code // (n_words + 1)).astype(np.int32)
    w = (code % (n_words + 1)).astype(np.int32)
    return part[order], h, w, n_train[order], hot[order], token_pair, history


def _read_documents(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens per document, whether it trains, and the tokens as 32-bit positions (a block has few enough)."""
    sizes, train, flat = load(raw)
    return sizes.astype(np.int64), train.astype(bool), flat.view(np.int32)


def _emit_pairs(n_total: int, parts: int):
    def run(words: pa.Table, docs: pa.Table) -> pa.Table:
        if docs.num_rows != 1:
            raise RuntimeError("a block was cut differently on a second read; write the documents to a table first")
        at = words.column("at").to_numpy()
        ids, c = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        ids[at], c[at] = words.column("id").to_numpy(), words.column("c").to_numpy()
        raw = docs.column("body")[0].as_py()
        sizes, train, flat = _read_documents(raw)
        part, h, w, n, hot, _, _ = _pairs(flat, sizes, train, ids, c, n_total, parts)
        name = docs.column("block")[0].as_py()
        rows = {"block": [name], "part": [-1], "body": [dump(ids, c.astype("<u4") if c.max(initial=0) < 1 << 32 else c)],
                "docs": [raw], "doc_ids": [docs.column("doc_ids")[0].as_py()]}
        cut = np.searchsorted(part, np.arange(parts + 1))
        h_id = np.append(ids, START)
        for p in np.flatnonzero(np.diff(cut)):
            s = slice(cut[p], cut[p + 1])
            first, size = _runs(h[s])
            hs = h_id[h[s][first]]
            rows["block"].append(name)
            rows["part"].append(int(p))
            rows["body"].append(dump(hs, size.astype("<u4"), hot[s][first].astype("<u1"), ids[w[s]], n[s].astype("<u4"), c[w[s]].astype("<u8")))
            rows["docs"].append(None)
            rows["doc_ids"].append(None)
        return pa.table(rows, schema=pa.schema([("block", pa.int64()), ("part", pa.int32()), ("body", pa.binary()),
                                                ("docs", pa.binary()), ("doc_ids", pa.list_(pa.int64()))]))
    return ta.tidy_group(run)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and their lengths."""
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(x)))


def _unigram(c: np.ndarray, n_total: int, d: np.ndarray) -> np.ndarray:
    return discounted(c, d) / max(n_total, 1)


def _count_part(n_total: int, d1: np.ndarray):
    """One history partition: sums the pairs' counts and answers every block that asked.

    An answer has each pair's count and, per history, what its backoff weight
    needs: how many words were seen 1..GT_K times, the number and sum of
    larger counts, and the unigram mass of the words seen.
    """
    def run(group: pa.Table) -> pa.Table:
        bodies = [load(x) for x in group.column("body").to_pylist()]
        h = np.concatenate([np.repeat(b[0], b[1]) for b in bodies])
        w, n, cw = (np.concatenate([b[k].astype(np.int64) for b in bodies]) for k in (3, 4, 5))
        order = np.lexsort((w, h))
        new = np.ones(len(order), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (w[order][1:] != w[order][:-1])
        pair = np.empty(len(order), np.int64)
        pair[order] = np.cumsum(new) - 1
        first = order[new]
        count = np.bincount(pair, weights=n).astype(np.int64)
        hs, of = np.unique(h[first], return_inverse=True)
        seen = count > 0
        stats = [np.bincount(of, weights=count == r, minlength=len(hs)) for r in range(1, GT_K + 1)]
        large = count > GT_K
        stats += [np.bincount(of, weights=large, minlength=len(hs)), np.bincount(of, weights=count * large, minlength=len(hs)),
                  np.bincount(of, weights=_unigram(cw[first], n_total, d1) * seen, minlength=len(hs))]
        out = {"block": [], "part": [], "body": [], "hot": [], "totals": []}
        at = 0
        part = group.column("part")[0].as_py()
        for name, b in zip(group.column("block").to_pylist(), bodies):
            size = len(b[3])
            mine = np.searchsorted(hs, b[0])
            out["block"].append(name)
            out["part"].append(part)
            out["body"].append(dump(count[pair[at:at + size]].astype("<u4"), *[s[mine].astype("<u4") for s in stats[:-1]], stats[-1][mine].astype("<f8")))
            out["hot"].append(None)
            out["totals"].append(None)
            at += size
        # partial sums of the histories that are split, and this partition's counts of counts
        split = np.unique(np.concatenate([b[0][b[2] > 0] for b in bodies]))
        out["block"].append(None)
        out["part"].append(part)
        out["body"].append(None)
        out["hot"].append([{"h": int(hs[i]), "s": [float(s[i]) for s in stats]} for i in np.searchsorted(hs, split)])
        out["totals"].append([int((count == r).sum()) for r in range(GT_K + 2)])
        return pa.table(out, schema=_ANSWER)
    return ta.tidy_group(run)


_ANSWER = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("body", pa.binary()),
                     ("hot", pa.list_(pa.struct([("h", pa.int64()), ("s", pa.list_(pa.float64()))]))), ("totals", pa.list_(pa.int64()))])


def _score_block(n_total: int, n_types: int, parts: int, d1, d2, unknown: float, hot: dict[int, list[float]]):
    def run(questions: pa.Table, answers: pa.Table) -> pa.Table:
        ids, c = (x.astype(np.int64) for x in load(questions.column("body")[0].as_py()))
        sizes, train, flat = _read_documents(questions.column("docs")[0].as_py())
        part, h, w, _, _, token_pair, history = _pairs(flat, sizes, train, ids, c, n_total, parts)
        cut = np.searchsorted(part, np.arange(parts + 1))
        count = np.zeros(len(part), np.uint32)
        stats = np.zeros((GT_K + 3, len(ids) + 1))              # of each history
        del part, w
        for p, raw in zip(answers.column("part").to_pylist(), answers.column("body").to_pylist()):
            got = load(raw)
            s = slice(cut[p], cut[p + 1])
            count[s] = got[0]
            first, _ = _runs(h[s])
            for k, x in enumerate(got[1:]):
                stats[k, h[s][first]] = x
        h_id = np.append(ids, START)
        for i in np.flatnonzero(np.isin(h_id, np.array(list(hot), np.int64))) if hot else ():
            stats[:, i] = hot[int(h_id[i])]
        r = np.arange(1, GT_K + 1)
        c_h = (r[:, None] * stats[:GT_K]).sum(0) + stats[GT_K + 1]
        mass = ((d2[1:] * r)[:, None] * stats[:GT_K]).sum(0) + stats[GT_K + 1] - TAIL * stats[GT_K]
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.where(c_h > 0, (1 - mass / np.maximum(c_h, 1)) / (1 - stats[GT_K + 2]), 1.0)
        known = c > 0
        p_word = np.where(known, _unigram(c, n_total, d1), unknown)
        p_pair = np.empty(len(count))                           # of a pair that was seen
        for a in range(0, len(count), PAIRS_AT_ONCE):
            s = slice(a, a + PAIRS_AT_ONCE)
            p_pair[s] = discounted(count[s], d2) / np.maximum(c_h[h[s]], 1)
        base = np.log10((c + 0.5) / (n_total + 0.5 * (n_types + 1)))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        n_known, base_score, total = np.zeros(len(sizes), np.int64), np.zeros(len(sizes)), np.zeros(len(sizes))
        for i, j in ta.chunks(ends, PAIRS_AT_ONCE):
            t = slice(ends[i], ends[j])
            starts, word, pair = ends[i:j] - ends[i], flat[t], token_pair[t]
            p = weight[history[t]] * p_word[word]               # back off
            seen = pair >= 0
            seen[seen] = count[pair[seen]] > 0
            p[seen] = p_pair[pair[seen]]
            np.log10(p, out=p)
            n_known[i:j] = np.add.reduceat(known[word], starts, dtype=np.int64)
            base_score[i:j] = np.add.reduceat(base[word], starts)
            total[i:j] = np.add.reduceat(p, starts)
        return pa.table({"doc_id": questions.column("doc_ids").combine_chunks().flatten(), "n_tokens": pa.array(sizes),
                         "n_known": pa.array(n_known), "base_score": pa.array(base_score), "score": pa.array(total)})
    return ta.tidy_group(run)


def score(docs: DataFrame, is_train, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Log10 probabilities of whole texts: ``doc_id, n_tokens, n_known, train_tokens, base_score, score``.

    ``is_train`` is a condition on ``doc_id`` for the rows that the counts
    come from (null counts as true).  A-Z are lower-cased; tokens are runs of
    non-blank characters and one end, so a null, empty or blank text has one
    token.  A token never seen in training has the probability of the unknown
    word.  Words are told apart by 64-bit hashes.  Repeated rows count as
    often as they occur, null ids stay; other columns are ignored; an empty
    table gives none, and without training rows every token is the unknown
    word with probability 1.  The rows are read twice and must come in the
    same batches (a scan does); if not, the join back raises an error.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "katz")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", "text", F.coalesce(is_train, F.lit(True)).alias("train"))

    # unigram table: every block's distinct words, dealt by word
    dealt = rows.mapInArrow(ta.tidy(_word_rows), "w long, block long, at int, n long").repartition("w")
    counted = dealt.withColumn("c", F.sum("n").over(Window.partitionBy("w"))).sortWithinPartitions("w")
    words = scratch.write(counted.mapInArrow(ta.tidy(_number), "block long, at int, id long, c long, is_first boolean"), "unigrams")
    firsts = words.where("is_first and c > 0")
    stat = firsts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), *[F.sum((F.col("c") == r).cast("long")).alias(f"n{r}") for r in range(1, GT_K + 2)],
                      F.sum((F.col("c") > GT_K).cast("long")).alias("large")).first()
    n_total, n_types = stat["n"] or 0, stat["v"]
    n1 = np.array([0.0] + [float(stat[f"n{r}"] or 0) for r in range(1, GT_K + 2)])
    d1 = discounts(n1)
    r = np.arange(1, GT_K + 1)
    lost = float(((1 - d1[1:]) * r * n1[1:GT_K + 1]).sum() + TAIL * (stat["large"] or 0))
    unknown = lost / n_total if n_total else 1.0

    # bigram table: every block's distinct pairs, dealt by history
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_total // PART_TOKENS)
    bodies = rows.mapInArrow(ta.tidy(_doc_rows), "block long, doc_ids array<long>, body binary")
    asked = (words.groupBy("block").cogroup(bodies.groupBy("block"))
             .applyInArrow(_emit_pairs(n_total, parts), "block long, part int, body binary, docs binary, doc_ids array<long>"))
    asked = scratch.write(asked, "pairs")
    answered = asked.where("part >= 0").select("block", "part", "body").groupBy("part").applyInArrow(
        _count_part(n_total, d1), "block long, part int, body binary, hot array<struct<h: long, s: array<double>>>, totals array<long>")
    answered = scratch.write(answered, "bigrams")
    totals = answered.where("totals is not null").agg(*[F.sum(F.col("totals")[k]).alias(f"n{k}") for k in range(GT_K + 2)]).first()
    d2 = discounts(np.array([0.0] + [float(totals[k] or 0) for k in range(1, GT_K + 2)]))
    split = answered.where("hot is not null").select(F.explode("hot").alias("x")).groupBy("x.h").agg(
        *[F.sum(F.col("x.s")[k]).alias(f"s{k}") for k in range(GT_K + 3)]).collect()        # at most HOT_SHARE rows
    hot = {row["h"]: [row[f"s{k}"] for k in range(GT_K + 3)] for row in split}

    scorer = _score_block(n_total, n_types, parts, d1, d2, unknown, hot)
    scored = (asked.where("part < 0").select("block", "body", "docs", "doc_ids").groupBy("block")
              .cogroup(answered.where("block is not null").select("block", "part", "body").groupBy("block"))
              .applyInArrow(scorer, "doc_id long, n_tokens long, n_known long, base_score double, score double"))
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(n_total).cast("long").alias("train_tokens"), "base_score", "score")
