"""Vector search, fixity and components against brute force; the pipeline's stages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF_SMALL
from turnstile.llm import ann, fixity, ngram_join, queries, topk
from turnstile.llm.components import connected_components


def vectors(spark, m, first=0):
    rows = [(first + i, [float(x) for x in v]) for i, v in enumerate(m)]
    odd = [(None, [1.0] * m.shape[1]), (10 ** 6, None), (10 ** 6 + 50, []), (10 ** 6 + 100, [None] * m.shape[1]),
           (10 ** 6 + 150, [float("nan")] * m.shape[1]), (10 ** 6 + 200, [float("inf")] * m.shape[1])]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("dim", F.lit("x"))


@pytest.mark.parametrize("lengths", ["equal", "spread"])
def test_top_products_equal_brute_force(spark, lengths):
    rng = np.random.default_rng(5)
    m = rng.standard_normal((400, 16)).astype(np.float32)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    if lengths == "spread":
        m *= np.exp(rng.standard_normal((400, 1)))
    m[100:130] = m[50]
    whole = np.floor(256 * m.astype(float)).astype(np.int64)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_products(vectors(spark, m), F.col("id") % 50 == 0).collect()}
    want = {}
    for q in range(0, 400, 50):
        s = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:5]
        want.update({(q, k + 1): (i, s[i]) for k, i in enumerate(order)})
    assert got == want


def test_top_products_with_few_or_no_rows(spark):
    few = vectors(spark, np.ones((3, 4), np.float32))
    assert [r.vec_id for r in topk.top_products(few, F.col("id") == 0).orderBy("rank").collect()] == [1, 2]
    assert topk.top_products(few.limit(0), F.col("id") == 0).count() == 0


def test_bucket_pruning_keeps_all_winners():
    rng = np.random.default_rng(1)
    m = rng.integers(-300, 300, (500, 12))
    lengths = np.sqrt((m ** 2).sum(1))
    unit_t = (m / lengths[:, None]).T
    for q in rng.integers(-300, 300, (40, 12)):
        s = m @ q
        for threshold in np.quantile(s, [0.3, 0.9, 0.99, 1.0]):
            kept = topk._candidates(unit_t, lengths, q, float(np.sqrt((q ** 2).sum())), float(threshold))
            assert set(np.flatnonzero(s >= threshold)) <= set(kept.tolist())


def test_nearest_neighbours_recall_and_edges(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 24))
    m = (centres[rng.integers(0, 30, 1500)] + 0.4 * rng.standard_normal((1500, 24))).astype(np.float32)
    m[200:260] = m[7]
    m[300] = 0
    rows = ann.nearest(vectors(spark, m), F.col("id") % 20 == 0, k=20).collect()
    exact = m.astype(float)
    hits = total = 0
    for q in range(0, 1500, 20):
        if q == 300:
            continue
        s = exact @ exact[q]
        order = [i for i in np.lexsort((np.arange(1500), -s)) if i not in (q, 300)][:20]
        mine = sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])
        assert len(mine) == 20 and [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        assert all(r.score == pytest.approx(s[r.vec_id], rel=1e-12) for r in mine)
        hits += len({r.vec_id for r in mine} & set(order))
        total += 20
    assert hits / total >= 0.9 and not any(r.query_id == 300 or r.vec_id == 300 for r in rows)
    few = vectors(spark, np.ones((3, 4), np.float32))
    assert [r.vec_id for r in ann.nearest(few, F.col("id") == 0).orderBy("rank").collect()] == [1, 2]
    assert ann.nearest(few.limit(0), F.col("id") == 0).count() == 0


def test_fixity_finds_only_the_damage(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").withColumn("hash", F.lit(1)).withColumn("part", F.lit(2))
    records = fixity.warc_records(pages, file_records=40)
    assert fixity.audit(records, records).count() == 0
    ids = sorted(r.record_id for r in records.select("record_id").collect())
    bad = (records.where(F.col("record_id") != ids[3])
           .withColumn("record", F.when(F.col("record_id") == ids[-1], F.concat("record", F.lit("x"))).otherwise(F.col("record"))))
    bad = bad.union(records.where(F.col("record_id") == ids[0]).withColumn("offset", F.lit(10 ** 9).cast("long")))
    got = {(r.record_id, r.status) for r in fixity.audit(records, bad).collect()}
    assert got == {(ids[3], "missing"), (ids[-1], "changed"), (ids[0], "extra")}
    none = records.limit(0)
    assert fixity.audit(none, none).count() == 0
    assert {r.status for r in fixity.audit(records, none).collect()} == {"missing"}
    odd = spark.createDataFrame([(None, None, None, None), (1, 0, None, "a"), (1, 0, None, "a")], "file long, offset long, record_id long, record string")
    assert fixity.audit(odd, odd).count() == 0 and fixity.audit(odd, odd.where("file is null")).count() == 1
    empty_pages = spark.createDataFrame([(None, None, None), (5, None, None)], "page_id long, url string, html string")
    assert fixity.warc_records(empty_pages).count() == 2


def test_components_of_chains_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark, edge_docs, no_docs):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality_classifier", "ngram_jaccard_join", "packing"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = {i for i in before if labels.get(i) == 1}
    known = corpus_pipeline.identify_language(spark, docs, sf_dir)
    assert known.columns == docs.columns and {r.doc_id for r in known.select("doc_id").collect()} >= good
    fine = corpus_pipeline.filter_quality(spark, docs, sf_dir)
    kept = {r.doc_id for r in fine.select("doc_id").collect()}
    assert fine.columns == docs.columns and len(good - kept) <= 0.01 * len(good)
    single = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    classes = ngram_join.jaccard_classes(docs, 5, (8, 10)).collect()
    assert {r.doc_id for r in single.collect()} == {r.component_id for r in classes} and single.columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, sf_dir).count() == 0
        stage(spark, edge_docs, sf_dir).collect()
    kept = corpus_pipeline.drop_near_duplicates(spark, edge_docs, sf_dir).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9] and len(kept) == 11


def test_query_names_and_full_pipeline(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    packed = corpus_pipeline.run(spark, SF_SMALL)
    assert packed.count() > 0 and packed.where("offset + length > 1024").isEmpty()
