"""Fixtures of the corpus operators' tests (the session comes from tests/conftest.py)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

EDGE_TEXTS = [None, "", "   \n\t ", "one", "One two", "one two three four five", "été naïve über 漢字 🙂 مرحبا",
              "<|endoftext|> a<|endoftext|>", "word " * 5000, "same text as another row here", "same text as another row here"]


@pytest.fixture(scope="session")
def edge_docs(spark, tmp_path_factory):
    """Edge texts, nulls in every column, repeated rows and columns with clashing names."""
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "src", None if t is None else len(t)) for i, t in enumerate(EDGE_TEXTS)]
    rows += [(None, "no id here at all", "en", "src", 3), rows[5], rows[5]]
    path = str(tmp_path_factory.mktemp("edge") / "docs")
    names = "doc_id long, text string, lang string, source string, n_chars long"
    clash = ["id", "block", "score", "row", "sig", "at", "w", "c", "h", "label", "place", "length", "word", "ids"]
    df = spark.createDataFrame(rows, names)
    for c in clash:
        df = df.withColumn(c, df.doc_id)
    df.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("doc_id < -1")
