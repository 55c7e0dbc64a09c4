"""The registered queries of the corpus operators, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.llm import (ann, bpe, divergence, fixity, html_text, katz, language_id, licenses, manifest, packing, quality, topk)
from turnstile.llm.ngram_join import jaccard_classes


def bpe_path() -> str:
    """The public byte-level BPE vocabulary with 50,257 ids."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents by links of Jaccard 0.9 over three-word shingles."""
    return jaccard_classes(_table(spark, sf_dir, "documents"), width=3, similarity=(9, 10))


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixity audit of the pages' WARC files against a replica with damage.

    The replica is derived from the same table: some pages have a byte
    appended or replaced, some records are lost.
    """
    pages = _table(spark, sf_dir, "pages")
    records = fixity.warc_records(pages)
    kind = F.conv(F.substring(F.md5(F.col("record_id").cast("string")), 1, 4), 16, 10).cast("long") % 97
    damaged = F.when(kind == 3, F.concat("record", F.lit("~"))).when(kind == 11, F.translate("record", "e", "3")).otherwise(F.col("record"))
    replica = records.withColumn("record", damaged).where(kind != 5)
    return fixity.audit(records, replica).select("record_id", "file", "offset", "status", "left_hash", "right_hash")


_OP2_SQL = r"""
WITH r AS (
  SELECT CAST(page_id // 1000 AS BIGINT) AS file, page_id AS record_id,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
         || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
         || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages),
o AS (
  SELECT *, CAST(sum(strlen(record)) OVER (PARTITION BY file ORDER BY record_id) - strlen(record) AS BIGINT) AS "offset"
  FROM r)
SELECT record_id, file, "offset",
       CASE kind WHEN 5 THEN 'missing' ELSE 'changed' END AS status,
       sha256(strlen(record) || '|' || record) AS left_hash,
       CASE kind WHEN 3 THEN sha256((strlen(record) + 1) || '|' || record || '~')
                 WHEN 11 THEN sha256(strlen(record) || '|' || replace(record, 'e', '3')) END AS right_hash
FROM (SELECT *, CAST('0x' || substr(md5(CAST(record_id AS VARCHAR)), 1, 4) AS INTEGER) % 97 AS kind FROM o) WHERE kind IN (3, 5, 11)
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of them."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    found = language_id.identify(docs, docs.where(~held_out))
    doc_id = F.col("row.doc_id")
    held_out = F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
    return found.select(doc_id, held_out.alias("held_out"), "lang_pred", "score")


def op4_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Katz backoff scores of all documents, learned from four fifths of them."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    scored = katz.score(_table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of the common license notices in all documents."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    path = bpe_path()
    coded = bpe.encode(_table(spark, sf_dir, "documents"), path, decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 ids."""
    return packing.pack(_table(spark, sf_dir, "documents"), bpe_path(), window=1024, end_id=0)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every twentieth vector."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op9_quality_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    scored = quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("row.doc_id", "content_score", "meta_score", "score")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 largest integer inner products of every fiftieth vector."""
    return topk.top_products(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5, scale=256)


_OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = html_text.extract(_table(spark, sf_dir, "pages"))
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents, and whether each row still proves its place after some were tampered with."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    now = F.when(tampered, manifest.leaf_digest("doc_id", "source", "lang", F.col("n_chars") + 1, "text"))
    made = manifest.manifest(_table(spark, sf_dir, "documents"), also={"now": now})
    made = made.withColumn("now", F.coalesce("now", "leaf"))
    return made.select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"),
                       manifest.fold("now").alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


_OP12_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS grp, n_chars,
         list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
           lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
             lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS c,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents),
h AS (
  SELECT doc_id, grp, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
         CASE WHEN xor(c, 4294967295) % 7 = 0 THEN sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail)
              ELSE sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) END AS now
  FROM d),
l AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM h),
t AS (
  SELECT grp, 0 AS level, place, leaf AS digest, count(*) OVER (PARTITION BY grp) AS n FROM l
  UNION ALL
  SELECT grp, level, place, sha256(string_agg(digest, '' ORDER BY seat)) AS digest, any_value((n + 1) // 2) AS n
  FROM (SELECT grp, level + 1 AS level, place // 2 AS place, digest, place AS seat, n FROM t WHERE n > 1) x GROUP BY grp, level, place),
s AS (SELECT grp, digest AS subroot, row_number() OVER (ORDER BY grp) - 1 AS place FROM t WHERE n = 1),
u AS (
  SELECT 0 AS level, place, subroot AS digest, count(*) OVER () AS n FROM s
  UNION ALL
  SELECT level, place, sha256(string_agg(digest, '' ORDER BY seat)) AS digest, any_value((n + 1) // 2) AS n
  FROM (SELECT level + 1 AS level, place // 2 AS place, digest, place AS seat, n FROM u WHERE n > 1) x GROUP BY level, place),
heights AS (SELECT grp, max(level) AS h FROM t GROUP BY grp),
low AS (
  SELECT l.grp, l.place, list(CASE WHEN b.digest IS NULL THEN '-' WHEN b.place % 2 = 1 THEN 'R' || b.digest ELSE 'L' || b.digest END ORDER BY k) AS path
  FROM (SELECT l.grp, l.place, unnest(range(0, h)) AS k FROM l JOIN heights USING (grp)) l
  LEFT JOIN t b ON b.grp = l.grp AND b.level = l.k AND b.place = xor(l.place >> l.k, 1) GROUP BY l.grp, l.place),
high AS (
  SELECT l.grp, list(CASE WHEN b.digest IS NULL THEN '-' WHEN b.place % 2 = 1 THEN 'R' || b.digest ELSE 'L' || b.digest END ORDER BY k) AS path
  FROM (SELECT grp, place, unnest(range(0, (SELECT max(level) FROM u))) AS k FROM s) l
  LEFT JOIN u b ON b.level = l.k AND b.place = xor(l.place >> l.k, 1) GROUP BY l.grp),
p AS (
  SELECT l.doc_id, l.leaf, l.now, s.subroot, list_concat(coalesce(low.path, []), coalesce(high.path, [])) AS path
  FROM l JOIN s USING (grp) LEFT JOIN low ON low.grp = l.grp AND low.place = l.place LEFT JOIN high ON high.grp = l.grp)
SELECT *, folded_root = root AS verified FROM (
  SELECT doc_id, leaf, subroot, (SELECT digest FROM u WHERE n = 1) AS root,
         sha256(list_aggregate(list_prepend('', list_transform(path, lambda x: substr(x, 2))), 'string_agg', '')) AS proof_sha256,
         list_reduce(list_prepend(now, path),
           lambda a, x: sha256(CASE x[1] WHEN 'L' THEN substr(x, 2) || a WHEN 'R' THEN a || substr(x, 2) ELSE a END)) AS folded_root
  FROM p)
"""


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ in their use of terms, over all documents."""
    return divergence.audit(_table(spark, sf_dir, "documents"))


_OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
o AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT i) >= 3),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN k ON o.lang = k.lang AND o.term = k.term GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
t AS (SELECT g.lang, g.source, coalesce(v.v, 0) AS v, coalesce(v.n, 0) AS lang_n, coalesce(sum(c.n), 0) AS n
      FROM g LEFT JOIN v ON g.lang = v.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
s AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
             (1 + (1000000000 * (coalesce(c.n, 0) + 1)::HUGEINT) // (t.n + t.v))::BIGINT AS p,
             (1 + (1000000000 * (k.n + 1)::HUGEINT) // (t.lang_n + t.v))::BIGINT AS q
      FROM t JOIN k ON t.lang = k.lang LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
w AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM s WHERE n > 0 AND p > q),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source)
SELECT lang, source, part, item, value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM w UNION ALL SELECT * FROM y) QUALIFY part = 'pair' OR rank <= 200
"""

QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_warc_fixity, op3_language_id, op4_katz_scoring, op5_bpe_round_trip, op6_license_scan, op7_packing,
    op8_nearest_neighbours, op9_quality_co_training, op10_exact_top_k, op11_html_extraction, op12_merkle_manifest, op13_source_divergence)}
ORACLES: dict[str, str] = {"op2_warc_fixity": _OP2_SQL, "op10_exact_top_k": _OP10_SQL, "op12_merkle_manifest": _OP12_SQL,
                           "op13_source_divergence": _OP13_SQL}
