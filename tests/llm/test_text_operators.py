"""Text operators against brute force, on edge rows and on the small tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF_SMALL
from turnstile.llm import bpe, katz, language_id, licenses, ngram_join, packing, quality, queries

PATH = queries.bpe_path()


def brute_classes(texts: dict, width: int, num: int, den: int):
    sets = {}
    for i, t in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(texts)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies():
    rng = np.random.default_rng(3)
    out, n = {}, 0
    for size in (3, 12, 40, 150, 700):
        base = [f"w{k}" for k in rng.integers(0, 5000, size)]
        for edits in (0, 0, 1, 2, size // 40, size // 25, size // 10, size // 3):
            text = list(base)
            for k in rng.integers(0, size, edits):
                text[k] = f"x{rng.integers(0, 10 ** 6)}"
            out[n], n = " ".join(text), n + 1
    return out


@pytest.mark.parametrize("width,num,den", [(3, 9, 10), (5, 8, 10)])
def test_jaccard_classes_equal_brute_force(spark, width, num, den):
    texts = near_copies()
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(df, width, (num, den)).collect()}
    assert got == brute_classes(texts, width, num, den)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 60), st.sampled_from([(9, 10), (8, 10), (1, 2)]), st.integers(0, 99))
def test_similar_sets_share_a_signature(size, dropped, added, similarity, seed):
    num, den = similarity
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 62, size, dtype=np.uint64)
    b = np.concatenate([a[min(dropped, size - 1):], rng.integers(0, 1 << 62, added, dtype=np.uint64)])
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b))
    if both * den < num * (len(a) + len(b) - both) or np.array_equal(a, b):
        return
    sig, of = ngram_join.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]), num, den)
    assert set(sig[of == 0].tolist()) & set(sig[of == 1].tolist())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 3)), max_size=40), st.lists(st.integers(0, 40), max_size=4))
def test_shared_signatures_are_found_across_batches(pairs, cuts):
    pairs = sorted(pairs)
    bounds = [0, *sorted(min(c, len(pairs)) for c in cuts), len(pairs)]
    batches = [pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs[i:j]], pa.int64()) for k in (0, 1)], names=["sig", "id"])
               for i, j in zip(bounds, bounds[1:])]
    holders = defaultdict(set)
    for sig, x in pairs:
        holders[sig].add(x)
    got = [tuple(r.values()) for b in ngram_join._shared(iter(batches)) for r in b.to_pylist()]
    assert got == sorted((sig, x, min(ids)) for sig, ids in holders.items() if len(ids) > 1 for x in ids)


def test_jaccard_edge_rows(edge_docs, no_docs):
    rows = ngram_join.jaccard_classes(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append((r.n_shingles, r.component_id))
    assert by_id[0] == [(0, 0)] and by_id[1] == [(0, 1)] and by_id[2] == [(0, 2)] and by_id[3] == [(1, 3)]
    assert by_id[5] == [(3, 5)] * 3 and by_id[10] == [(4, 9)] and by_id[8] == [(1, 8)]
    assert by_id[None] == [(3, None)]
    assert ngram_join.jaccard_classes(no_docs).count() == 0


def test_bpe_round_trip_and_edges(edge_docs, no_docs):
    tok = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text or "" for r in edge_docs.collect()}
    rows = bpe.decode(bpe.encode(edge_docs, PATH), PATH).collect()
    assert sorted(bpe.encode(edge_docs, PATH, decoded=True).collect(), key=str) == sorted(rows, key=str)
    assert len(rows) == edge_docs.count()
    for r in rows:
        ids = tok.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded == tok.decode(ids, skip_special_tokens=False)
    assert bpe.encode(no_docs, PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab '\n\t\r\x0b\x1c\x85\xa0  é1½!.<|>٣漢🙂s", max_size=40))
def test_units_do_not_cut_words(text):
    whole = Tokenizer.from_file(PATH) if not hasattr(test_units_do_not_cut_words, "tok") else test_units_do_not_cut_words.tok
    test_units_do_not_cut_words.tok = whole
    block = bpe.Block(PATH)
    block.add(pa.array([text]))
    pos, _ = block.positions()
    words = list(block.words)
    assert [t for p in pos for t in bpe.encode_words([words[p]], PATH)[0].tolist()] == whole.encode(text, add_special_tokens=False).ids


def test_packing_covers_every_id_once(spark, edge_docs, no_docs):
    tok = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = packing.pack(docs, PATH, window=128, keep_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_doc[r.doc_id].append((r.start, bytes(r.ids)))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, t in texts.items():
        want = np.array(tok.encode(t, add_special_tokens=False).ids + [0], "<u4").tobytes()
        assert b"".join(x for _, x in sorted(by_doc[i])) == want
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 128
    total = sum(r.length for r in rows)
    assert total / (128 * len(by_sequence)) > 0.97
    assert packing.pack(edge_docs, PATH).agg(F.countDistinct("sequence_id")).first()[0] >= 1
    assert packing.pack(edge_docs, PATH).count() >= edge_docs.count()
    assert packing.pack(no_docs, PATH).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=12))
def test_plan_uses_every_piece(counts):
    used = Counter()
    for shape, n in packing.plan(counts, 64):
        assert sum(shape) <= 64 and n > 0
        for c in shape:
            used[c] += n
    assert used == Counter(counts)


def test_katz_equals_direct_evaluation(spark, edge_docs, no_docs):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 1 for r in docs.collect()}
    tokens = {r.doc_id: (r.text or "").encode().lower().split() + ["END"] for r in docs.collect()}
    uni, after = Counter(), defaultdict(Counter)
    for i, t in tokens.items():
        if not held[i]:
            uni.update(t)
            for h, w in zip(["START", *t], t):
                after[h][w] += 1
    n = sum(uni.values())

    def table(counts):
        of = Counter(counts)
        return katz.discounts(np.array([0.0] + [float(of[r]) for r in range(1, katz.GT_K + 2)]))
    d1, d2 = table(uni.values()), table(c for x in after.values() for c in x.values())

    def disc(c, d):
        return d[c] * c if c <= katz.GT_K else c - katz.TAIL
    p1 = {w: disc(c, d1) / n for w, c in uni.items()}
    unknown = 1 - sum(p1.values())
    size = {h: sum(x.values()) for h, x in after.items()}
    weight = {h: (1 - sum(disc(c, d2) for c in x.values()) / size[h]) / (1 - sum(p1[w] for w in x)) for h, x in after.items()}

    def p(h, w):
        c = after[h][w] if h in after and w in after[h] else 0
        return disc(c, d2) / size[h] if c else weight.get(h, 1.0) * p1.get(w, unknown)
    common = max((h for h in after if h != "START"), key=lambda h: size[h])
    assert sum(p(common, w) for w in uni) + p(common, "never seen") == pytest.approx(1, abs=1e-9)
    rows = queries.op4_katz_scoring(spark, SF_SMALL).collect()
    assert len(rows) == len(tokens)
    for r in rows:
        t = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(w in uni for w in t), n, held[r.doc_id])
        assert r.score == pytest.approx(sum(math.log10(p(h, w)) for h, w in zip(["START", *t], t)), rel=1e-9)
        assert r.base_score == pytest.approx(sum(math.log10((uni.get(w, 0) + 0.5) / (n + 0.5 * (len(uni) + 1))) for w in t), rel=1e-9)
    out = katz.score(edge_docs, F.col("doc_id") % 2 == 0).collect()
    assert len(out) == edge_docs.count() and all(math.isfinite(r.score) for r in out)
    assert katz.score(no_docs, F.lit(True)).count() == 0
    nothing = katz.score(edge_docs, F.lit(False)).collect()
    assert all(r.score == 0 and r.train_tokens == 0 for r in nothing)


def test_language_id_on_held_out_documents(spark, edge_docs, no_docs):
    rows = queries.op3_language_id(spark, "/root/testdata/sf0.01").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    held = rows[rows.held_out].merge(truth, on="doc_id")
    assert len(rows) == len(truth) and (held.lang == held.lang_pred).mean() > 0.97
    assert rows.score.between(0, 1).all()
    out = language_id.identify(edge_docs, edge_docs).select("row.doc_id", "row.text", "lang_pred", "score").collect()
    assert len(out) == edge_docs.count()
    assert all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or "")) for r in out)
    assert language_id.identify(no_docs, no_docs).count() == 0
    assert {r.lang_pred for r in language_id.identify(edge_docs, no_docs).collect()} == {"und"}


def test_quality_on_labelled_documents(spark, edge_docs, no_docs):
    rows = queries.op9_quality_co_training(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    both = rows.merge(labels.toPandas(), on="doc_id")
    assert ((both.score >= 0.5) == (both.quality == 1)).mean() > 0.95
    out = quality.classify(edge_docs, labels.withColumn("doc_id", F.col("doc_id") % 11)).collect()
    assert len(out) == edge_docs.count() and all(0 <= r.score <= 1 for r in out)
    assert {round(r.score, 6) for r in quality.classify(edge_docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(no_docs, labels).count() == 0


def test_license_scan_finds_every_notice(spark, edge_docs, no_docs):
    filler = " ".join(f"w{k}" for k in range(997))
    rows = [(i, f"{filler[:at]} {text} {filler[at:]}") for i, (text, at) in
            enumerate((t, at) for t in licenses.NOTICES.values() for at in (0, 17, 1200, len(filler)))]
    changed = licenses.NOTICES["MIT-grant"].split()
    changed[20] = changed[40] = "other"
    rows += [(900, " ".join(changed)), (901, filler)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.license) for r in licenses.scan(df).collect()}
    names = [n for n in licenses.NOTICES for _ in range(4)]
    assert all((i, n) in found for i, n in enumerate(names))
    assert (900, "MIT-grant") in found and not any(i == 901 for i, _ in found)
    assert licenses.scan(edge_docs).count() == 0 and licenses.scan(no_docs).count() == 0
    assert licenses.scan(df, templates={}).count() == 0
    whole = licenses.scan(df, templates={"w": " ".join(f"w{k}" for k in range(300, 420))}).collect()
    assert len({r.doc_id for r in whole}) >= len(rows) - 5 and all(r.containment >= 0.8 for r in whole)

def test_rows_without_an_id_are_bridges(spark):
    """1 ~ none ~ 2, with no link between 1 and 2 themselves."""
    words = [f"w{k}" for k in range(120)]
    left, right = ["a", "b", "c", "d"] + words[4:], words[:-4] + ["x", "y", "z", "q"]
    df = spark.createDataFrame([(1, " ".join(left)), (None, " ".join(words)), (2, " ".join(right)), (None, "none has this text at all")],
                               "doc_id long, text string")
    for shown in (df, df.withColumn("doc_id", df.doc_id)):
        got = ngram_join.jaccard_classes(shown, 3, (9, 10)).collect()
        assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (None, 1), (None, None)}


def test_memory_is_released_and_results_stay(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(20)], "doc_id long, text string")
    from turnstile.llm import textarrays
    textarrays._powers(textarrays.CHUNK_BYTES * 3)
    textarrays.release()
    assert not textarrays._POWERS
    assert packing.pack(docs, PATH, window=64, end_id=0).agg(F.sum("length")).first()[0] == sum(
        len(Tokenizer.from_file(PATH).encode(f"text {i} " * 50, add_special_tokens=False).ids) + 1 for i in range(20))
