"""Source divergence audit by a pointer sort of term starts.

Terms are runs of letters: ASCII letters and all characters beyond ASCII.  A
task slices its shard of documents into text buffers, sets a pointer to the
start of every term and sorts the pointers by multikey quicksort over the
buffer.  Equal runs of pointers give each term's documents and its
occurrences per source; Spark adds the runs of all shards up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstile.llm.scratch import Scratch
from turnstile.llm.textarrays import chunks, lower_ascii, text_buffer

SLICE_BYTES = 8 << 20     # text sorted at once; a longer document stands alone
SMALL = 1 << 14           # slices of so many pointers are sorted without a pivot
SHARD_ROWS = 100_000      # term counts of one shard of a language
CELLS = 1 << 21           # cells of a (source, term) table in memory
MIN_DOCUMENTS = 3
TERM_RANKS = 200
SCALE = 1_000_000_000

_INK = np.zeros(256, bool)
_INK[ord("A"):ord("Z") + 1] = _INK[ord("a"):ord("z") + 1] = _INK[0x80:] = True
# what of eight bytes belongs to a term that has 0 to 8 of them left
_MASKS = np.array([0] + [((1 << 8 * k) - 1) << 8 * (8 - k) for k in range(1, 9)], np.uint64)


def terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the terms in a buffer of documents, and each term's row."""
    ink = np.zeros(len(data) + 2, np.int8)
    ink[1:-1] = _INK[data]
    step = np.diff(ink)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = np.unique(cuts[_INK[data[cuts - 1]] & _INK[data[cuts]]]) if len(cuts) else cuts      # a document ends inside a run
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def _character(words: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Eight bytes at each pointer as one character; bytes beyond a term are zero."""
    left = np.clip(ends - at, 0, 8)
    return words[np.minimum(at, len(words) - 1)].astype(np.uint64) & _MASKS[left]


def sort_pointers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of term pointers.

    Returns the sorted order and, for each place in it, whether a run of equal
    terms begins there.  A character is eight bytes.  A slice is split in three
    about a pivot character; its equal part goes on with the next character,
    until the terms end.  Small slices of one depth are sorted together.
    """
    n = len(starts)
    order, first = np.arange(n), np.zeros(n, bool)
    if n == 0:
        return order, first
    first[0] = True
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), ">u8", padded.tobytes(), 0, (1,))
    slices, depth = [(0, n)], 0
    while slices:
        deeper: list[tuple[int, int]] = []
        small: list[tuple[int, int]] = []
        while slices:
            lo, hi = slices.pop()
            if hi - lo <= SMALL:
                small.append((lo, hi))
                continue
            own = order[lo:hi]
            char = _character(words, starts[own] + 8 * depth, ends[own])
            sample = np.sort(char[:: max(1, len(char) // 63)])
            pivot = sample[len(sample) // 2]
            less, more = char < pivot, char > pivot
            a, b = lo + int(less.sum()), hi - int(more.sum())
            order[lo:hi] = np.concatenate([own[less], own[~(less | more)], own[more]])
            first[a] = True
            if b < hi:
                first[b] = True
                slices.append((b, hi))
            if a > lo:
                slices.append((lo, a))
            if int(pivot) & 0xFF and b - a > 1:
                deeper.append((a, b))
        if small:
            lows, sizes = np.array([s[0] for s in small]), np.array([s[1] - s[0] for s in small])
            part = np.repeat(np.arange(len(small)), sizes)
            place = np.repeat(lows - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            own = order[place]
            char = _character(words, starts[own] + 8 * depth, ends[own])
            by = np.lexsort((char, part))
            own, char = own[by], char[by]
            order[place] = own
            new = np.ones(len(own), bool)
            new[1:] = (part[1:] != part[:-1]) | (char[1:] != char[:-1])
            first[place[new]] = True
            begin = np.flatnonzero(new)
            size = np.diff(np.append(begin, len(own)))
            open_ = ((char[begin] & np.uint64(0xFF)) != 0) & (size > 1)
            deeper += list(zip(place[begin[open_]].tolist(), (place[begin[open_]] + size[open_]).tolist()))
        slices, depth = deeper, depth + 1
    return order, first


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges as an Arrow string column."""
    sizes = ends - starts
    offs = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=offs[1:])
    body = data[np.repeat(starts - offs[:-1], sizes) + np.arange(offs[-1])]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(body)))


def _slice_counts(data: np.ndarray, offs: np.ndarray, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Term, group, occurrences and documents of every term and group of a buffer."""
    data = lower_ascii(data)
    starts, ends, rows = terms(data, offs)
    order, first = sort_pointers(data, starts, ends)
    run = np.cumsum(first) - 1
    by_group = np.argsort(group, kind="stable")
    rank = np.empty(len(group), np.int64)
    rank[by_group] = np.arange(len(group))
    pairs = np.sort(run * len(group) + rank[rows[order]])          # run, then group, then row
    new = np.ones(len(pairs), bool)
    new[1:] = pairs[1:] != pairs[:-1]
    docs = np.flatnonzero(new)                                     # one per term and document
    term, own = pairs[docs] // max(1, len(group)), group[by_group][pairs[docs] % max(1, len(group))]
    lead = np.ones(len(docs), bool)
    lead[1:] = (term[1:] != term[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(lead)
    n_docs = np.diff(np.append(at, len(docs)))
    n = np.diff(np.append(docs[at], len(pairs)))
    head = order[np.flatnonzero(first)]
    return _strings(data, starts[head], ends[head]).take(pa.array(term[at])), own[at], n, n_docs


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [pc.fill_null(batch[c].cast(pa.large_string()), "").dictionary_encode() for c in ("lang", "source")]
        codes = [k.indices.to_numpy(zero_copy_only=False).astype(np.int64) for k in keys]
        group = codes[0] * max(1, len(keys[1].dictionary)) + codes[1]
        raw, offs = text_buffer(batch["text"])
        for i, j in chunks(offs, SLICE_BYTES):
            term, own, n, n_docs = _slice_counts(raw[offs[i]:offs[j]], offs[i:j + 1] - offs[i], group[i:j])
            lang, source = own // max(1, len(keys[1].dictionary)), own % max(1, len(keys[1].dictionary))
            for at in range(0, len(n), 1 << 16):
                cut = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [keys[0].dictionary.take(pa.array(lang[cut])).cast(pa.string()), keys[1].dictionary.take(pa.array(source[cut])).cast(pa.string()),
                     term[cut].cast(pa.string()), pa.array(n[cut], pa.int64()), pa.array(n_docs[cut], pa.int64())], ["lang", "source", "term", "n", "n_docs"])


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, term, n, n_docs``: occurrences and documents of every term per language and source."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    found = rows.mapInArrow(_counts, "lang string, source string, term string, n long, n_docs long")
    return found.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def _share(count: str, total: str) -> str:
    """Smoothed share in parts of SCALE, exact beyond 64 bits on the way."""
    return f"1 + (cast({SCALE} as decimal(19,0)) * cast({count} + 1 as decimal(19,0))) div cast({total} as decimal(19,0))"


def pair_sums(term: np.ndarray, source: np.ndarray, p: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """For sources a and b, the sum of ``(p_a - p_b)^2 // p_b`` over the terms ``0 .. max(term)``.

    ``p`` are the shares of the (term, source) pairs that occur, ``zero`` each
    source's share of a term that it lacks.  Work grows with the pairs that
    occur times the sources; terms that both lack are counted, not visited.
    """
    s = len(zero)
    out = np.zeros((s, s), np.int64)
    if len(term) == 0:
        return out
    order = np.argsort(term, kind="stable")
    term, source, p = term[order], source[order], p[order]
    width, n_terms = max(1, CELLS // s), int(term[-1]) + 1
    lack = (zero[:, None] - zero[None, :]) ** 2 // zero[None, :]
    for at in range(0, n_terms, width):
        i, j = np.searchsorted(term, [at, at + width])
        share = np.repeat(zero[:, None], min(width, n_terms - at), axis=1)
        has = np.zeros(share.shape, bool)
        share[source[i:j], term[i:j] - at] = p[i:j]
        has[source[i:j], term[i:j] - at] = True
        for a in range(s):
            own = np.flatnonzero(has[a])
            other = share[:, own]
            out[a] += ((share[a, own] - other) ** 2 // other).sum(1)
            out[:, a] += np.where(has[:, own], 0, (zero[:, None] - share[a, own]) ** 2 // share[a, own]).sum(1)
        none = (~has).astype(np.float64)
        out += (none @ none.T).astype(np.int64) * lack
    return out


def _pairs(key, counts: pa.Table, sources: pa.Table) -> pa.Table:
    """One shard of a language's terms: its part of every pair's sum."""
    names = sources["source"].to_pylist()
    at = {s: i for i, s in enumerate(names)}
    terms_ = counts["term"].combine_chunks().dictionary_encode()
    codes = terms_.indices.to_numpy(zero_copy_only=False) if len(counts) else np.zeros(0, np.int64)
    sums = pair_sums(codes.astype(np.int64), np.array([at[s] for s in counts["source"].to_pylist()], np.int64),
                     counts["p"].to_numpy().astype(np.int64), sources["zero"].to_numpy().astype(np.int64))
    a, b = np.nonzero(~np.eye(len(names), dtype=bool))
    column = pa.array(names, pa.string())
    return pa.table({"lang": pa.array([key[0].as_py()] * len(a), pa.string()), "source": column.take(pa.array(a)),
                     "item": column.take(pa.array(b)), "value": pa.array(sums[a, b], pa.int64())})


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, term_ranks: int = TERM_RANKS, text_col: str = "text",
          lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """How the sources of each language differ in their use of terms.

    Returns ``lang, source, part, item, value, rank``.  Part ``pair`` has one
    row for each other source of the language; part ``term`` has the source's
    ``term_ranks`` most over-used terms against the language.  A language
    keeps the terms in at least ``min_documents`` of its documents.  Shares
    are smoothed, in parts of 10^9; ``value`` is ``(p - q)^2 // q``, for a
    pair summed over all kept terms.  Ranks go by value, then item.  Null
    texts, languages and sources are empty ones; a source without terms still
    has pairs; repeated rows count as documents of their own; texts are read
    whole; other columns are ignored; an empty table has no rows.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    counts = term_counts(docs, text_col, lang_col, source_col)
    of_term = Window.partitionBy("lang", "term")
    kept = (counts.withColumn("in_docs", F.sum("n_docs").over(of_term)).withColumn("lang_n", F.sum("n").over(of_term))
            .withColumn("place", F.row_number().over(of_term.orderBy("source"))).where(F.col("in_docs") >= min_documents)
            .select("lang", "source", "term", "n", "lang_n", (F.col("place") == 1).cast("long").alias("lead")))
    kept = scratch.write(kept, "kept")
    names = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
                        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).distinct()
    of_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("lead").alias("v"), F.count(F.lit(1)).alias("n_rows"))
    groups = names.join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0)
    shards = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / SHARD_ROWS)).cast("int")
    groups = scratch.write(groups.withColumn("shards", shards), "groups")

    scored = kept.join(groups, ["lang", "source"]).withColumn("p", F.expr(_share("n", "total + v"))).withColumn("q", F.expr(_share("lang_n", "lang_total + v")))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = scored.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                        F.expr("((p - q) * (p - q)) div q").alias("value"))
    over = over.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= term_ranks)

    left = scored.select("lang", F.pmod(F.xxhash64("term"), "shards").cast("int").alias("shard"), "term", "source", "p")
    zero = F.when(F.col("v") > 0, F.expr(_share("0", "total + v"))).otherwise(1)
    right = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "source", zero.alias("zero"))
    sums = left.groupBy("lang", "shard").cogroup(right.groupBy("lang", "shard")).applyInArrow(_pairs, "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(by_value))
    return over.unionByName(pairs)
