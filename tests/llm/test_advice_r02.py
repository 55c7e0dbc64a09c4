
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from turnstile.llm import ann, language_id, licenses, quality, topk
from turnstile.llm.components import connected_components
from turnstile.llm.scratch import Scratch


def random_groups():
    """Chains and trees, one group at a time, numbered at random."""
    rng = np.random.default_rng(11)
    out = [[(2, 3), (3, 4), (4, 5), (1, 5)]]
    for size in (6, 8):
        name = rng.permutation(size).tolist()
        out.append([(name[i], name[i + 1]) for i in range(size - 1)])
        out.append([(name[i], name[int(rng.integers(0, i))]) for i in range(1, size)])
    return out


@pytest.mark.parametrize("links", random_groups())
def test_one_group_is_one_component(spark, links):
    got = sorted((r.id, r.component) for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    ids = sorted({x for link in links for x in link})
    assert got == [(i, ids[0]) for i in ids]


def quality_docs(n_good, n_bad):
    """Prose of common words, then noise of digits and marks."""
    rng = np.random.default_rng(5)
    words = ["river", "stone", "winter", "market", "little", "garden", "evening", "people", "walked", "across", "the", "and", "of", "a"]
    good = [" ".join(rng.choice(words, 60)) for _ in range(n_good)]
    bad = [" ".join(f"{x}#$" for x in rng.integers(0, 10 ** 6, 60)) for _ in range(n_bad)]
    return [(i, t, "en", "web", len(t)) for i, t in enumerate(good + bad)]


@pytest.mark.parametrize("labels,kept", [
    ([(60, 0)], set(range(66))),                                            # one class: nothing to tell apart
    ([(i, 0) for i in range(60, 66)] * 5, set(range(66))),
    ([(60, 0), (61, 0), (62, 0), (63, 0), (0, 1)], None),                    # few labels, still both kinds
])
def test_quality_stage_keeps_clean_documents(spark, tmp_path, labels, kept):
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(quality_docs(60, 6), "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.filter_quality(spark, docs, str(tmp_path)).collect()}
    assert got == (set(range(60)) if kept is None else kept)


def test_rare_bad_labels_reject_bad_documents(spark):
    rows = quality_docs(600, 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1) for i in range(500)] + [(i, 0) for i in range(600, 608)], "doc_id long, quality int")
    scores = {r.row.doc_id: r.score for r in quality.classify(docs, labels, n_labelled=40).collect()}
    assert min(scores[i] for i in range(600)) >= 0.5 > max(scores[i] for i in range(600, 640))


def recall(spark, m, every):
    """Share of the 20 nearest of each ``every``-th vector that are found."""
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "vec_id long, embedding array<float>")
    found = {}
    for r in ann.nearest(df, F.col("id") % every == 0, k=20).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, len(m), every):
        near = m.astype(float) @ m[q].astype(float)
        near[q] = -np.inf
        hits += len(found[q] & set(np.argsort(-near, kind="stable")[:20].tolist()))
    return hits / (20 * len(range(0, len(m), every)))


def test_one_long_vector_does_not_spoil_the_graph(spark):
    rng = np.random.default_rng(4)
    m = rng.standard_normal((16000, 16))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    m[5] *= 100
    assert recall(spark, m.astype(np.float32), 400) >= 0.9


def test_walk_goes_on_while_a_beam_node_is_not_expanded(spark):
    nodes = spark.createDataFrame([(i, [float(i)]) for i in range(9)], "id long, vector array<float>")
    graph = spark.createDataFrame([(i, i + 1, 0.0) for i in range(8)], "u long, v long, near double")
    queries = spark.createDataFrame([(0, [1.0])], "query long, q array<float>")
    entries = spark.createDataFrame([(0, 0)], "query long, node long")
    found = ann.search(graph, nodes, queries, entries, Scratch(spark, "walk"), k=3).collect()
    assert sorted(r.node for r in found) == [6, 7, 8]


def brute_products(rows, is_query, k, own_product):
    """(query id, rank) to (id, score), by comparing all rows of other ids."""
    out = {}
    for q in sorted({i for i, _ in rows if is_query(i)}):
        pairs = [(own_product(x, y), j) for i, x in rows if i == q for j, y in rows if j != q and len(x) == len(y)]
        for rank, (s, j) in enumerate(sorted(pairs, key=lambda p: (-p[0], p[1]))[:k], 1):
            out[q, rank] = (j, s)
    return out


def test_repeated_ids_and_other_dimensions_take_part(spark):
    """Every row is a candidate: those that repeat an id, and those of a rarer dimension."""
    rng = np.random.default_rng(21)
    rows = [(i, [float(x) for x in rng.integers(-9, 9, 2) + 0.5]) for i in range(60)]
    rows += [(1, [50.5, 50.5]), (0, [9.5, 9.5]), (20, [-40.5, 7.5])]                    # other vectors of known ids
    rows += [(100 + i, [float(x) for x in rng.integers(-9, 9, 3) + 0.5]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_products(df, F.col("id") % 20 == 0).collect()}
    assert got == brute_products(rows, lambda i: i % 20 == 0, 5, lambda x, y: sum(int(256 * a) * int(256 * b) for a, b in zip(x, y)))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.nearest(df, F.col("id") % 20 == 0, k=7).collect()}
    assert got == brute_products(rows, lambda i: i % 20 == 0, 7, lambda x, y: sum(a * b for a, b in zip(x, y)))
    assert got[0, 1][0] == 1 and got[100, 1][0] > 100


def test_equal_rows_are_equal_candidates(spark):
    """As in the query's SQL, rows that occur twice are two candidates of the exact search; the graph search gives them once."""
    df = spark.createDataFrame([(0, [1.0]), (1, [3.0]), (1, [3.0]), (2, [2.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in topk.top_products(df, F.col("id") == 0, k=3, scale=1).orderBy("rank").collect()] == [1, 1, 2]
    assert [r.vec_id for r in ann.nearest(df, F.col("id") == 0, k=3).orderBy("rank").collect()] == [1, 2]


def plain_notices(text, template, width=5):
    """Spans of the template's own words in a text, by trying every place."""
    w, t = text.split(), template.split()
    return [(i, i + len(t)) for i in range(len(w) - len(t) + 1) if w[i:i + len(t)] == t]


def test_repeated_notices_are_separate(spark):
    notice = " ".join(f"n{k}" for k in range(67))
    other = " ".join(f"f{k}" for k in range(400))
    gap = " ".join(f"g{k}" for k in range(20))
    texts = [f"{other} {notice} {other}", f"{other} {notice} {notice} {other}", f"{notice} {gap} {notice}", " ".join([notice] * 7),
             f"{notice} {other} {notice}", f"n3 n4 n5 n6 n7 n8 {notice} n60 n61 n62 n63 n64 {other}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.first_word, r.end_word) for r in licenses.scan(df, templates={"n": notice}).collect())
    assert got == sorted((i, a, b) for i, t in enumerate(texts) for a, b in plain_notices(t, notice))
    halves = f"{' '.join(notice.split()[:34])} {gap} {gap} {' '.join(notice.split()[34:])} {other}"       # one window holds both
    assert licenses.scan(spark.createDataFrame([(1, halves)], "doc_id long, text string"), templates={"n": notice}).count() == 1
    refrain = " ".join(["one two three four five six", notice, "one two three four five six"])
    df = spark.createDataFrame([(1, f"{other} {refrain} {other}")], "doc_id long, text string")
    assert [(r.first_word, r.end_word, r.containment) for r in licenses.scan(df, templates={"r": refrain}).collect()] == [(400, 479, 1.0)]
    with pytest.raises(ValueError):
        licenses.scan(df, threshold=0.7)


def test_kernel_equals_sets(spark):
    """The classifier's scores against a kernel of plain n-gram sets, with no bound on n-grams."""
    rng = np.random.default_rng(3)
    alphabets = {"a": "abcdefghij", "b": "fghijklmno", "c": "日本語漢字仮名交文"}
    rows = [("".join(rng.choice(list(letters), 60)), lang) for lang, letters in alphabets.items() for _ in range(40)]
    texts, langs = [t for t, _ in rows], [x for _, x in rows]
    model = language_id.fit(texts, langs, landmarks_per_language=10)

    def grams(t):
        b = t.encode()
        return {b[i:i + n] for n in (1, 2, 3) for i in range(len(b) - n + 1)}

    marks = [grams(t) for x in sorted(set(langs)) for t in [t for t, y in rows if y == x][:10]]
    known = set().union(*marks)
    assert sum(map(len, model.grams)) == len(known)

    def kernel(x, y):
        x, y = x & known, y & known
        return len(x & y) / np.sqrt(len(x) * len(y))

    k = np.array([[kernel(grams(t), m) for m in marks] for t in texts])
    value, vector = np.linalg.eigh(np.array([[kernel(x, y) for y in marks] for x in marks]))
    z = k @ (vector / np.sqrt(value))
    y = np.array([[float(x == name) for name in sorted(set(langs))] for x in langs])
    zc, yc = z.mean(0), y.mean(0)
    coef = np.linalg.solve((z - zc).T @ (z - zc) + 0.1 * np.eye(z.shape[1]), (z - zc).T @ (y - yc))
    want = (z - zc) @ coef + yc
    data, offs = language_id._joined(texts)
    x = language_id.presence(data, offs, model.tables(), len(model.weights)).astype(np.float32)
    got = x @ model.weights / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1)) + model.bias
    assert np.abs(got - want).max() < 2e-3


def test_long_unlabelled_texts_can_be_pseudo_labelled(spark):
    """Only the labelled sample is bound by ``max_chars``: with all unlabelled texts beyond it the model still learns from them."""
    rows = quality_docs(60, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    shortest = min(len(t) for _, t, *_ in rows)
    known = [*range(20), *range(60, 80)]
    labels = spark.createDataFrame([(i, int(i < 60)) for i in known], "doc_id long, quality int")
    few = docs.withColumn("text", F.when(F.col("doc_id").isin(known), F.substring("text", 1, shortest - 1)).otherwise(F.col("text")))
    alone = few.where(F.col("doc_id").isin(known))
    with_long, without = quality.fit(few, labels, max_chars=shortest - 1), quality.fit(alone, labels, max_chars=shortest - 1)
    rest = few.where(~F.col("doc_id").isin(known))
    a, b = ({r.row.doc_id: r.score for r in quality.score(rest, m).collect()} for m in (with_long, without))
    assert a != b and min(a[i] for i in range(20, 60)) > max(a[i] for i in range(80, 120))


def test_rows_that_share_an_id_stay_unless_copies(spark):
    """A row's text decides, not its id."""
    words = " ".join(f"w{k}" for k in range(80))
    unique = " ".join(f"u{k}" for k in range(80))
    third = " ".join(f"t{k}" for k in range(80))
    rows = [(3, words), (5, words + " tail"), (5, unique), (5, unique), (None, words), (None, third), (None, third + " tail"), (None, None), (7, None), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    alike = [(i, t) for i, t in got if i is None and t is not None]
    assert len(alike) == 1 and alike[0][1].startswith(third)
    assert sorted((str(i), t or "") for i, t in got if (i, t) not in alike) == [("3", words), ("5", unique), ("7", ""), ("8", ""), ("None", "")]
