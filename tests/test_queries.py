"""Differential test: every registered query against its DuckDB oracle.

Runs at sf0.001 (fast); ``scripts/check_oracles.py`` runs the same at sf0.01.
Model queries (no oracle) are run for their row counts.
"""

import os
import sys

import pytest

from conftest import ROOT, SF_SMALL

sys.path.insert(0, os.path.join(ROOT, "scripts"))
import __spark_entry__ as entry  # noqa: E402
from check_oracles import compare, duck_con  # noqa: E402

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()
SLOW = {"tuned_trials", "model_validation_metrics", "batch_predictions"}


@pytest.fixture(scope="module")
def con():
    return duck_con(SF_SMALL)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 40


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "daily_ridership" in df.columns


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in SLOW))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF_SMALL, strict=True)
    assert r["ok"], r.get("problems")


@pytest.mark.parametrize("name", sorted(SLOW))
def test_model_queries_run(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() > 0
