"""What a step of a Python worker allocates on top of its input, for each token, byte or row."""

import tracemalloc

import numpy as np
import pyarrow as pa

from turnstile.llm import katz, quality


def _peak(run):
    tracemalloc.start()
    try:
        out = run()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def _block(n_docs=400, length=1000, n_words=40_000):
    """A block's documents and its words, as the joins hand them over; every document ends with word 0."""
    rng = np.random.default_rng(7)
    flat = rng.zipf(1.3, n_docs * length) % n_words
    flat[length - 1::length] = 0
    flat = np.unique(flat, return_inverse=True)[1]
    sizes, train = np.full(n_docs, length), np.arange(n_docs) % 5 != 1
    c = np.bincount(flat, weights=np.repeat(train, sizes)).astype(np.int64)
    words = pa.table({"block": pa.array(np.full(len(c), 9)), "at": pa.array(np.arange(len(c), dtype=np.int32)),
                      "id": pa.array(np.arange(len(c)) * 3), "c": pa.array(c)})
    docs = pa.table({"block": [9], "doc_ids": [list(range(n_docs))],
                     "body": [katz.dump(sizes.astype("<u4"), train.astype("<u1"), flat.astype("<u4"))]})
    return words, docs, len(flat), int(c.sum())


def test_katz_blocks_take_few_bytes_a_token():
    words, docs, n, total = _block()
    d, parts = katz.discounts(np.zeros(katz.GT_K + 2)), 8
    asked, peak = _peak(lambda: katz._emit_pairs(total, parts)(words, docs))
    assert peak < 50 * n
    rows = asked.to_pylist()
    assert rows[0]["part"] == -1
    answers = []
    for p in range(parts):
        group = pa.Table.from_pylist([r for r in rows if r["part"] == p], asked.schema)
        if group.num_rows:
            got = katz._count_part(total, d)(group.select(["block", "part", "body"]))
            answers += [r for r in got.to_pylist() if r["block"] is not None]
    question = asked.slice(0, 1).select(["block", "body", "docs", "doc_ids"])
    answer = pa.Table.from_pylist(answers, katz._ANSWER).select(["block", "part", "body"])
    scored, peak = _peak(lambda: katz._score_block(total, words.num_rows, parts, d, d, 1e-4, {})(question, answer))
    assert peak < 50 * n
    assert scored.column("n_tokens").to_pylist() == [1000] * 400
    assert np.isfinite(scored.column("score").to_numpy()).all()


def test_features_and_the_surest_texts_take_few_bytes():
    words = ["alpha", "be", "Gamma,", "delta-9", "x"]
    texts = [" ".join(words[(i + k * k) % 5] for k in range(180)) for i in range(4000)]
    size = sum(map(len, texts))
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts, "lang": ["en"] * len(texts),
                             "source": ["a"] * len(texts), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                             "h": pa.array(range(len(texts)), pa.int64())})
    views = lambda: [content.shape for _, content, _ in quality._views(batch)]       # noqa: E731
    shapes, peak = _peak(views)
    assert sum(n for n, _ in shapes) == len(texts) and size > 3 << 20
    assert peak < 42 << 20
    rows = pa.Table.from_batches(list(quality._features([batch]))).combine_chunks().to_batches()[0]
    rows = pa.RecordBatch.from_arrays([rows.column(c) for c in ("h", "content", "meta")], names=["h", "content", "meta"])
    weights = [np.zeros(quality.N_CONTENT + 1), np.zeros(quality.N_META + 1)]
    best, peak = _peak(lambda: list(quality._surest(weights, 0.0, np.zeros(0, np.int64), 50, 0.5)([rows])))
    assert peak < 9 << 20
    assert all(b.column("h").to_pylist() == list(range(50)) for b in best) and len(best) == 4
