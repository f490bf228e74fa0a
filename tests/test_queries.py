"""Registered queries against their comparison SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, connection

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connection(SF)


#: A spread of queries by default; TEST_ALL=1 (or tests/compare.py) takes every one, as the correctness run does.
NAMES = list(entry.oracle_sql()) if os.environ.get("TEST_ALL") else list(entry.oracle_sql())[::5]


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", ["trade_signals_flagship", "backtest_by_regime", "model_determinism", "stream_sliding_statistics"])
def test_runs_without_sql(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0


def test_entry_without_the_corpus_operators(monkeypatch):
    monkeypatch.setattr(entry, "find_spec", lambda name: None)
    assert "trade_signals_flagship" in entry.queries() and not [n for n in entry.queries() if n == "pipeline" or n.startswith("op")]
    assert set(entry.oracle_sql()) <= set(entry.queries())
