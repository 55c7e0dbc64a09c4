"""Faults named by the findings of round 3."""

from llm.test_text_operators import brute_classes
from turnstile.llm import ngram_join


def test_few_pairs_just_below_the_similarity_are_compared(spark, monkeypatch):
    """Texts made from one by five edits, any two with at most one in common, all a little too different: sketches rule most pairs out."""
    texts = {}
    for i in range(60):
        words = [f"w{k}" for k in range(384)]
        for k in range(5):
            words[5 + 5 * (13 * k + (i + i // 13 * k) % 13)] = f"own{i}-{k}"
        texts[i] = " ".join(words)
    texts[60] = texts[7] + " end"
    compared, verified = [], ngram_join._verified

    def watched(pairs, *rest):
        compared.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(ngram_join, "_verified", watched)
    monkeypatch.setattr(ngram_join, "CROWD", 2, raising=False)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(df, 5, (8, 10)).collect()}
    assert got == brute_classes(texts, 5, 8, 10)
    assert len({c for _, c in got.values()}) == 60
    assert sum(compared[1:]) < 1000, compared         # of 1,830 pairs
