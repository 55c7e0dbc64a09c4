"""The corpus pipeline: language ID, quality, near duplicates, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a frame that is
written as Parquet and read back as the next stage's ``docs``.  All but the
last return the columns of ``documents``.  Any column may hold nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.llm import language_id, ngram_join, packing, quality
from turnstile.llm.queries import bpe_path
from turnstile.llm.scratch import Scratch

MIN_LANGUAGE_SCORE = 0.35     # a text that no known language explains better is rejected
MIN_QUALITY = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty ones too) or of no known language.

    The model learns from the documents' own non-null ``lang``; without any,
    nothing can be told and all documents with a letter stay.
    """
    found = language_id.identify(docs, docs)
    if docs.where("lang is not null").isEmpty():
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("row.*")


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the co-trained classifier holds for bad; where it tells none apart (no labels, or of one class), all stay."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    model = quality.fit(docs, labels)
    if not model.informed:
        return docs
    return quality.score(docs, model).where(F.col("score") >= MIN_QUALITY).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near duplicates: the one with the smallest id.

    Classes join rows with a Jaccard similarity of 0.8 or more over five-word
    shingles.  Rows are told apart by a hash of all their columns, not by id:
    rows that share an id, or have none, are compared like any others and all
    stay unless their texts are near duplicates or the rows are equal.  An id
    is preferred to none.
    """
    rows = docs.select(F.xxhash64(*docs.columns).alias("key"), F.struct(*docs.columns).alias("row"))
    named = rows.select("key", F.col("row.text").alias("text"))
    classes = ngram_join.jaccard_classes(named, width=5, similarity=(8, 10), id_col="key").select(F.col("doc_id").alias("key"), "component_id")
    ids = rows.select("key", F.col("row.doc_id").alias("doc_id")).distinct()
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best")
    kept = classes.distinct().join(ids, "key").groupBy("component_id").agg(best).select("best.key")
    # equal rows meet before they are shuffled
    return rows.dropDuplicates(["key"]).join(kept, "key", "left_semi").select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 ids."""
    return packing.pack(docs, bpe_path(), window=1024, end_id=0)


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", filter_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("packing", pack_sequences),
]

ORACLE_SQL = None     # classifiers and packing have no SQL form; tests/llm checks the stages


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``; every stage's result is written and read back."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
