"""Faults named by the check of round 3: the driver's memory in the near-duplicate join."""

import random

from llm.test_text_operators import brute_classes
from turnstile.llm import ngram_join


def _texts():
    rng = random.Random(11)
    texts = {}
    for i in range(40):
        words = [f"w{rng.randint(0, 10 ** 6)}" for _ in range(120)]
        for k in range(4):
            texts[10 * i + k] = " ".join(words)
            words = words[:]
            words[rng.randrange(120)] = f"own{i}-{k}"
    return texts


def test_many_signatures_move_in_more_slices(spark, monkeypatch):
    texts = _texts()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    held, open_pairs = [], ngram_join._open_pairs

    def watched(mixed, *rest):
        held.append(mixed.count())
        return open_pairs(mixed, *rest)

    monkeypatch.setattr(ngram_join, "_open_pairs", watched)
    monkeypatch.setattr(ngram_join, "_star_pairs", lambda held, *rest: held.where("false").selectExpr("first as a", "id as b"))
    monkeypatch.setattr(ngram_join, "_mixed", lambda held, merged, share, f=ngram_join._mixed: f(held, merged, share).where("true" if share == 1 else "false"))
    for rows, slices in ((1 << 19, 3), (1, ngram_join.SLICES)):
        monkeypatch.setattr(ngram_join, "SLICE_ROWS", rows)
        held.clear()
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(df, 5, (8, 10)).collect()}
        assert got == brute_classes(texts, 5, 8, 10)
        assert len(held) == 1 + slices and all(held[1:])


def test_open_pairs_are_not_broadcast(spark):
    """Crowded and other signatures go through one plan, of merge joins however small the tables."""
    docs = spark.createDataFrame([(1, 10, 10, 10, False), (1, 11, 11, 10, False), (2, 10, 10, 10, True), (2, 12, 12, 10, True)],
                                 "sig long, id long, class long, main long, crowded boolean")
    word = [0] * 3
    sketches = spark.createDataFrame([(10, 20, word + [1], word * 10 + [1, 0]), (11, 20, word + [3], word * 10 + [-1, -1]),
                                      (12, 20, word + [3], word * 10 + [-1, -1])],
                                     "id long, n long, sketch array<long>, fine array<long>")
    pairs = ngram_join._open_pairs(docs, sketches, 8, 10)
    assert [(r.a, r.b) for r in pairs.collect()] == [(10, 11)]      # the crowded one is ruled out by its longer sketch
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
