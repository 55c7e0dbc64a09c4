"""Faults named by the check of round 3: time of packing, disk of the near-duplicate join."""

import random

from llm.test_text_operators import brute_classes
from turnstile.llm import bpe, ngram_join
from turnstile.llm.queries import bpe_path


class _Watched:
    """A tokenizer that keeps what it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.calls = tokenizer, []

    def encode_batch(self, batch, **more):
        self.calls += [(more["is_pretokenized"], x) for x in batch]
        return self.tokenizer.encode_batch(batch, **more)


def test_words_after_a_blank_are_encoded_as_joined_texts(monkeypatch):
    path = bpe_path()
    tokenizer = bpe._tokenizer(path)
    rng = random.Random(5)
    kinds = ["abcXYZ", "0189", "!?<|>", "éß中", "́‍", "�\x00\x1f"]
    words = [" " + "".join(rng.choices(rng.choice(kinds), k=rng.randint(1, 9))) for _ in range(700)]
    words += [" ", "  ", " 　", "\n", "\n\n", "'s", "start", "<|endoftext|>", " <|endof", "text|>", " \x85", "\xa0 "]
    words = [w for text in words for w in ([text] if text == "<|endoftext|>" else bpe._WORD.findall(text))]
    words = list(dict.fromkeys(words))
    rng.shuffle(words)
    want = [tokenizer.encode([w], is_pretokenized=True, add_special_tokens=False).ids for w in words]

    watched = _Watched(tokenizer)
    monkeypatch.setattr(bpe, "_tokenizer", lambda path: watched)
    ids, sizes = bpe.encode_words(words, path)
    ends = sizes.cumsum()
    assert [ids[e - n:e].tolist() for e, n in zip(ends, sizes)] == want
    alone = [w for whole, x in watched.calls if whole for w in x]
    assert "<|endoftext|>" in alone and "'s" in alone
    assert not [w for w in alone if len(w) > 1 and w[0] == " " and not w[1].isspace()]   # none of these stood alone
    assert bpe.encode_words([], path)[0].tolist() == []


def test_sketches_move_for_a_part_of_the_signatures_at_a_time(spark, monkeypatch):
    rng = random.Random(7)
    texts = {}
    for i in range(40):
        words = [f"w{rng.randint(0, 10 ** 6)}" for _ in range(120)]
        for k in range(4):
            texts[10 * i + k] = " ".join(words)
            words = words[:]
            words[rng.randrange(120)] = f"own{i}-{k}"
    moved, open_pairs = [], ngram_join._open_pairs

    def watched(mixed, *rest):
        moved.append({r.sig for r in mixed.select("sig").distinct().collect()})
        return open_pairs(mixed, *rest)

    monkeypatch.setattr(ngram_join, "_open_pairs", watched)
    monkeypatch.setattr(ngram_join, "_star_pairs", lambda held, *rest: held.where("false").selectExpr("first as a", "id as b"))
    monkeypatch.setattr(ngram_join, "_mixed", lambda held, merged, share, f=ngram_join._mixed: f(held, merged, share).where("true" if share == 1 else "false"))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(df, 5, (8, 10)).collect()}
    assert got == brute_classes(texts, 5, 8, 10)
    assert len({c for _, c in got.values()}) < len(texts)
    every = set().union(*moved)
    assert len(every) > 100
    assert sum(map(len, moved)) == len(every)              # each signature is in one part
    assert max(map(len, moved)) < len(every) / 2
