"""N-gram Jaccard join with PartEnum signatures.

Documents become sets of word shingles.  Two sets with Jaccard similarity at
least ``g`` and sizes in one size band differ in at most
``k = (1-g)/(1+g) * 2 * (largest size of the band)`` elements.  The element
domain is dealt by hash into ``n1 = ceil((k+1)/2)`` parts of three cells.
Some part then holds at most one difference, which lies in one cell, so the
two other cells agree: enumerating the three pairs of cells of every part
gives signatures of which similar sets share at least one.  Every set signs
for its own band, and for the next one if a partner may lie there.

Sets that share a signature are compared exactly, so no link is missed or
invented.  Identical sets are folded into one class first.  Within a
signature's sets, the one with the smallest id is tried with the others (each
set with the nearest of those), links merge classes, and only sets of
different classes are compared further.  All comparisons start with parity
sketches, the later ones inside the join: bit ``h(x) mod m``
flips for each element ``x``, so two sketches differ in at most as many bits
as the sets differ in elements, and a larger distance rules a pair out
without a row being made for it.  A pair meets at every signature that it
shares, so a share of the signatures is tried first, and what that links is
not compared again; where a signature has many sets outside its main class,
longer sketches of these sets rule out most of the pairs just below the
similarity too.  Sketches are joined to the signatures slice by slice, so only
a part of these rows is on disk at a time.

There are many short jobs here, so what they leave in the driver adds up: joins
whose sides have been shuffled anyway are hinted to merge, as a broadcast would
save nothing on large tables and passes the driver on small ones.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.llm import textarrays as ta
from turnstile.llm.components import connected_components
from turnstile.llm.scratch import Scratch

BAND_RATIO = 1.25
CELLS = 3
CROWD = 16             # sets outside a signature's main class; of more, longer sketches are compared
FINE = 8               # how many times as long these are
SLICES = 8             # parts of all signatures whose sketches move one after the other, at most
SLICE_ROWS = 1 << 19   # rows of signatures that need no more parts


def size_bands(largest: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest sizes of the bands up to ``largest``, and each band's ``k``."""
    lows = [1]
    while lows[-1] <= largest:
        # a partner is at most den/num times as large, so it lies in the same band or the next
        lows.append(max(lows[-1] + 1, math.ceil(lows[-1] * BAND_RATIO), -(-lows[-1] * den // num)))
    lows = np.array(lows, np.int64)
    highs = lows[1:] - 1
    return lows[:-1], (2 * highs * (den - num)) // (den + num)


def signatures(elements: np.ndarray, sizes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """PartEnum signatures of sets laid end to end: (signature, set index).

    ``num/den`` is the similarity.  Bands whose ``k`` is 0 only pair equal
    sets, which need no signature.  A part can be empty in a set; a set with
    at most ``spare`` such parts does not sign for them, because the number
    of parts leaves more than ``spare`` agreeing parts for any partner.
    """
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(sizes) == 0 or sizes.max() == 0:
        return none
    lows, ks = size_bands(int(sizes.max() * den // num + 1), num, den)
    own = np.searchsorted(lows, sizes, "right") - 1
    out_sig, out_set = [], []
    for step in (0, 1):
        band = np.minimum(own + step, len(lows) - 1)
        use = (sizes > 0) & (own + step < len(lows)) & (ks[band] > 0)
        if step:                                            # a partner in the next band is possible
            use &= sizes * den >= lows[band] * num
        picked = np.flatnonzero(use)
        if not len(picked):
            continue
        k = ks[band[picked]]
        spare = 1 + k // 50
        parts = k // 2 + 1 + spare
        base = np.concatenate([[0], np.cumsum(parts)])
        where = np.full(len(sizes), -1, np.int64)
        where[picked] = np.arange(len(picked))
        of = np.repeat(where, sizes)
        inside = of >= 0
        e, of = elements[inside], of[inside]
        place = ta.mix64(e + np.uint64(0x51ED270B))
        part = (place >> np.uint64(32)).astype(np.int64) % parts[of]
        cell = (place & np.uint64(0xFFFF)).astype(np.int64) % CELLS
        at = (base[of] + part) * CELLS + cell
        sums = np.zeros(base[-1] * CELLS, np.uint64)
        np.add.at(sums, at, ta.mix64(e ^ np.uint64(0xA5A5F00D)))
        held = np.bincount(at, minlength=base[-1] * CELLS).reshape(-1, CELLS)
        sums = sums.reshape(-1, CELLS)
        owner = np.repeat(np.arange(len(picked)), parts)
        index = np.arange(base[-1]) - base[owner]
        tag = ta.mix64((band[picked][owner].astype(np.uint64) << np.uint64(40)) + (index.astype(np.uint64) << np.uint64(2)))
        sig = ta.mix64((sums.sum(1, dtype=np.uint64)[:, None] - sums) + tag[:, None] + np.arange(CELLS, dtype=np.uint64))
        empty = (held.sum(1)[:, None] - held) == 0
        hollow = np.bincount(owner, weights=empty.any(1), minlength=len(picked)).astype(np.int64)
        keep = ~(empty.any(1) & (hollow <= spare)[owner])
        out_sig.append(sig[keep].ravel())
        out_set.append(np.repeat(picked[owner[keep]], CELLS))
    return (np.concatenate(out_sig), np.concatenate(out_set)) if out_sig else none


def _sets(batch, width):
    """Per chunk of rows: row range, set sizes, and the sets end to end."""
    data, offs = ta.text_buffer(batch.column(1))
    for i, j in ta.chunks(offs):
        part, at = ta.lower_ascii(data[offs[i]:offs[j]]), offs[i:j + 1] - offs[i]
        s, e, rows = ta.words(part, at)
        h, rows = ta.shingles(ta.word_hashes(part, s, e), rows, j - i, width)
        h, rows = ta.distinct_sorted(h, rows)
        yield i, j, np.bincount(rows, minlength=j - i).astype(np.int64), h


def _set_ids(elements, sizes):
    """Two order-free 64-bit sums that name a set."""
    ends = np.cumsum(sizes)
    ids = []
    for salt in (0x1234567, 0x7654321):
        run = np.concatenate([[np.uint64(0)], np.cumsum(ta.mix64(elements + np.uint64(salt)), dtype=np.uint64)])
        ids.append(ta.mix64(run[ends] - run[ends - sizes] + sizes.astype(np.uint64)).view(np.int64))
    return ids


def _describe(width):
    def run(batches):
        for b in batches:
            for i, j, sizes, h in _sets(b, width):
                a, c = _set_ids(h, sizes)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(sizes), pa.array(a), pa.array(c)],
                    names=["doc_id", "n_shingles", "set_id", "set_check"])
    return ta.tidy(run)


def _sign(width, num, den):
    def run(batches):
        for b in batches:
            for _, _, sizes, h in _sets(b, width):
                a, _ = _set_ids(h, sizes)
                sig, of = signatures(h, sizes, num, den)
                once = np.zeros(len(a), bool)
                once[np.unique(a, return_index=True)[1]] = True         # copies in a chunk sign once
                sig, of = sig[once[of]], of[once[of]]
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(a[of])], names=["sig", "id"])
    return ta.tidy(run)


def _shared(batches):
    """From rows sorted by (sig, id), the distinct ones of signatures with two ids or more, and each one's smallest id.

    Only the last signature's smallest and last id are kept from batch to batch.
    """
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        sig, ids = b.column("sig").to_numpy(), b.column("id").to_numpy()
        told = 0                                            # rows in front that were given before
        if last is not None:
            sig = np.concatenate([[last[0], last[0]], sig])
            ids = np.concatenate([[last[1], last[2]], ids])
            told = 2 if last[1] != last[2] else 0
        change = np.concatenate([[True], sig[1:] != sig[:-1]])
        keep = change.copy()
        keep[1:] |= ids[1:] != ids[:-1]
        sig, ids, change = sig[keep], ids[keep], change[keep]
        start = np.flatnonzero(change)
        size = np.diff(np.append(start, len(sig)))
        first = np.repeat(ids[start], size)
        give = np.repeat(size > 1, size)
        give[:told] = False
        last = sig[-1], first[-1], ids[-1]
        yield pa.RecordBatch.from_arrays([pa.array(x[give]) for x in (sig, ids, first)], names=["sig", "id", "first"])


def _elements(width, num, den):
    def run(batches):
        for b in batches:
            for _, _, sizes, h in _sets(b, width):
                a, _ = _set_ids(h, sizes)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                sketch, bounds = parity_sketches(h, sizes, num, den)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64))),
                     pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(sketch.view(np.int64)))],
                    names=["id", "elements", "sketch"])
    return ta.tidy(run)


def _sketches(num, den):
    """Sizes and sketches of sets, and sketches of FINE times the length from their elements."""
    def run(batches):
        for b in batches:
            held = b.column("elements")
            h = held.flatten().to_numpy().view(np.uint64)
            sizes = held.value_lengths().to_numpy().astype(np.int64)
            fine, bounds = parity_sketches(h, sizes, num, den, FINE)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(sizes), b.column("sketch"),
                 pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(fine.view(np.int64)))],
                names=["id", "n", "sketch", "fine"])
    return ta.tidy(run)


def parity_sketches(elements: np.ndarray, sizes: np.ndarray, num: int, den: int, times: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Parity bits of each set, as 64-bit words end to end, and their bounds.

    The number of words is a power of two of about six bits per difference
    allowed, or ``times`` (a power of two) as many, so that sketches of
    neighbouring lengths fold onto each other.
    """
    need = np.maximum(4, sizes * 12.0 * (den - num) / (den + num) / 64)
    n_words = (2 ** np.ceil(np.log2(need))).astype(np.int64) * times
    bounds = np.concatenate([[0], np.cumsum(n_words)])
    of = np.repeat(np.arange(len(sizes)), sizes)
    place = ta.mix64(elements + np.uint64(0xB17))
    word = (place & np.uint64(0xFFFFFFFF)).astype(np.int64) % n_words[of]
    out = np.zeros(bounds[-1], np.uint64)
    np.bitwise_xor.at(out, bounds[of] + word, np.uint64(1) << (place >> np.uint64(58)))
    return out, bounds


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose sets are similar enough, compared element by element."""
    sized = (pairs.join(sets.select(F.col("id").alias("b"), F.col("elements").alias("eb")), "b")
             .join(sets.select(F.col("id").alias("a"), F.col("elements").alias("ea")), "a"))
    na, nb = F.size("ea").cast("long"), F.size("eb").cast("long")
    both = F.size(F.array_intersect("ea", "eb")).cast("long")
    fits = F.least(na, nb) * den >= F.greatest(na, nb) * num
    return sized.where(fits).withColumn("both", both).where(F.col("both") * (num + den) >= (na + nb) * num).select("a", "b")


def jaccard_classes(docs: DataFrame, width: int = 3, similarity: tuple[int, int] = (9, 10),
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents connected by word-shingle similarity.

    Returns ``doc_id, n_shingles, component_id`` (smallest id reachable by
    links) and ``class_size``, one row per input row.

    Words are runs of non-blank characters, A-Z lower-cased.  A text of fewer
    than ``width`` words is one shingle of all its words; a null, empty or
    blank text has no shingles, links with nothing and is its own class.
    Rows that share an id are kept as separate rows and take part with their
    own texts; so do rows with a null id, which belong to the class that they
    link with and are null in ``component_id`` if it has no id.  Other columns are ignored.
    An empty table gives an empty result.  Long texts are taken whole.
    """
    num, den = similarity
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = scratch.write(
        texts.mapInArrow(_describe(width), "doc_id long, n_shingles long, set_id long, set_check long"), "rows")
    with_words = rows.where("n_shingles > 0")

    # signatures held by at least two different sets, and their holders: one sorted shuffle, read as a stream
    signed = texts.select("doc_id", "text").mapInArrow(_sign(width, num, den), "sig long, id long")
    held = signed.repartition("sig").sortWithinPartitions("sig", "id").mapInArrow(_shared, "sig long, id long, first long")
    held = scratch.write(held, "held")

    live = scratch.write(held.select("id").distinct(), "live")
    some = with_words.groupBy("set_id").agg(F.min("doc_id").alias("doc_id")).join(live, F.col("set_id") == F.col("id"), "left_semi")
    # a set is built from the text of its smallest id; rows without an id may hold sets that no other row has
    firsts = texts.where("text is not null").join(some.select("doc_id"), "doc_id", "left_semi")
    sets = (firsts.union(texts.where("text is not null and doc_id is null"))
            .mapInArrow(_elements(width, num, den), "id long, elements array<long>, sketch array<long>"))
    sets = scratch.write(sets.join(live, "id", "left_semi").dropDuplicates(["id"]), "sets")

    scratch.drop(live)

    def verified(pairs, name):
        """Links of the possible pairs; what finding these shuffled is gone before elements move."""
        pairs = scratch.write(pairs, f"pairs-{name}")
        links = scratch.write(_verified(pairs, sets, num, den), f"links-{name}")
        scratch.drop(pairs)
        return links

    links = verified(_star_pairs(held, sets, num, den), "star")
    merged = connected_components(links)
    sketches = scratch.write(sets.mapInArrow(_sketches(num, den), "id long, n long, sketch array<long>, fine array<long>"), "sketches")
    for share, least, most in ((16, 1, 1), (1, 3, SLICES)):
        mixed = scratch.write(_mixed(held, merged, share), "mixed")
        slices = min(most, max(least, -(-mixed.count() // SLICE_ROWS))) if most > least else most
        # a set's sketches move with each of its signatures: what one slice shuffled is gone before the next
        pairs = [scratch.write(_open_pairs(_slice(mixed, k, slices), sketches, num, den), f"open-{share}-{k}") for k in range(slices)]
        found = verified(functools.reduce(DataFrame.union, pairs).distinct(), str(share))
        scratch.drop(mixed, *pairs)
        if not found.isEmpty():
            links = scratch.write(links.union(found), "links")
            merged = connected_components(links)
    scratch.drop(sketches)

    classes = (with_words.join(merged.hint("merge"), F.col("set_id") == F.col("id"), "left")
               .withColumn("class", F.coalesce("component", "set_id"))
               .withColumn("check", F.when(F.col("component").isNull(), F.col("set_check"))))
    sized = classes.groupBy("class", "check").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("class_size"))
    named = (classes.join(sized.withColumnsRenamed({"class": "class_", "check": "check_"}).hint("merge"),
                          (F.col("class") == F.col("class_")) & F.col("check").eqNullSafe(F.col("check_")))
             .select("doc_id", "n_shingles", "component_id", "class_size"))
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"),
                                                F.lit(1).cast("long").alias("class_size"))
    return named.union(alone)


def _star_pairs(held: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """For each set, the one of its signatures' smallest sets that is nearest by sketch and not ruled out by it.

    Sets that this leaves unlinked meet again in the open pairs, which miss none.
    """
    small = sets.select("id", F.size("elements").cast("long").alias("n"), "sketch")
    pairs = held.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    both = (pairs.join(small.withColumnsRenamed({"id": "a", "n": "na", "sketch": "sa"}).hint("merge"), "a")
            .join(small.withColumnsRenamed({"id": "b", "n": "nb", "sketch": "sb"}).hint("merge"), "b")
            .where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
            .withColumn("apart", F.expr(_distance("sa", "sb"))))
    near = both.where(F.col("apart") * (num + den) <= (F.col("na") + F.col("nb")) * (den - num))
    return near.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("best")).select("best.a", "b")


def _mixed(held: DataFrame, merged: DataFrame, share: int) -> DataFrame:
    """Holders of signatures with sets of several classes: ``sig, id, class, main, crowded``.

    ``main`` is a signature's most frequent class; ``crowded`` tells whether
    more than CROWD sets are outside it.  One signature in ``share`` by hash
    is taken; with 1, all.
    """
    if share > 1:
        held = held.where(F.pmod(F.xxhash64("sig"), F.lit(share)) == 0)
    now = held.join(merged.hint("merge"), "id", "left").select("sig", "id", F.coalesce("component", "id").alias("class"))
    counts = now.groupBy("sig", "class").agg(F.count("*").alias("n"))
    main = counts.groupBy("sig").agg(F.max(F.struct("n", "class")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("kinds"))
    main = main.where("kinds > 1").select("sig", F.col("top.class").alias("main"), (F.col("all") - F.col("top.n") > CROWD).alias("crowded"))
    return now.join(main.hint("merge"), "sig")


def _slice(mixed: DataFrame, k: int, slices: int) -> DataFrame:
    """The ``k``-th of ``slices`` parts by signature; each signature is whole in one."""
    return mixed.where(F.pmod(F.xxhash64("sig"), F.lit(slices)) == k) if slices > 1 else mixed


def _open_pairs(mixed: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Possible links (a, b) between sets that share a signature but not yet a class, and that no sketch rules out.

    In each signature the most frequent class needs no pairs within itself,
    so every open pair has a member outside it: each such member is tried
    against all sets of other classes.  In crowded signatures, longer
    sketches are compared too; the others do not carry them.  All signatures
    go through one plan of merge joins: this runs for every slice, and each
    join that is broadcast, like each stage, costs the driver memory.
    """
    held = mixed.join(sketches.hint("merge"), "id").withColumn("fine", F.when(F.col("crowded"), F.col("fine")))
    x, y = held.where(F.col("class") != F.col("main")).alias("x"), held.alias("y")
    near, finer = (f"{_distance(f'x.{c}', f'y.{c}')} * {num + den} <= (x.n + y.n) * {den - num}" for c in ("sketch", "fine"))
    return (x.join(y.hint("merge"), F.expr(f"""x.sig = y.sig and x.class <> y.class and (y.class = y.main or x.id < y.id)
                and least(x.n, y.n) * {den} >= greatest(x.n, y.n) * {num} and {near} and (not x.crowded or {finer})"""))
            .select(F.expr("least(x.id, y.id) a"), F.expr("greatest(x.id, y.id) b")).distinct())


def _distance(x: str, y: str) -> str:
    """SQL for the number of differing bits; the longer sketch is folded first."""
    def fold(z, other):
        half = f"cast(size({z}) / 2 as int)"
        return (f"if(size({z}) > size({other}), zip_with(slice({z}, 1, {half}), "
                f"slice({z}, {half} + 1, {half}), (p, q) -> p ^ q), {z})")
    return f"aggregate(zip_with({fold(x, y)}, {fold(y, x)}, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)"
