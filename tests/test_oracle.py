"""Every registered query against its DuckDB oracle (row count, column names and types, values)."""

import os

import pytest

from conftest import SF_SMALL

import __spark_entry__ as entry
from prefspark.plans.catalog import QUERIES
from tools.oracle_check import check

SQL_NAMES = sorted(entry.oracle_sql())
ROWS_ONLY = sorted(set(entry.queries()) - set(entry.oracle_sql()))


@pytest.fixture(scope="module")
def results(spark):
    return check(spark, SF_SMALL)


@pytest.mark.parametrize("name", SQL_NAMES)
def test_query_matches_oracle(results, name):
    res = results[name]
    assert res.get("ok") is True, res


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_query_runs(results, name):
    res = results[name]
    assert "error" not in res, res
    assert res["rows"] > 0


def test_every_query_has_oracle_or_is_rows_only():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(ROWS_ONLY) & set(QUERIES) == set()  # the training-data operators have tests of their own


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert [f.name for f in df.schema.fields] == ["flipped", "n_rows", "prompt_words", "chosen_words",
                                                  "rejected_words", "prompt_non_null"]
    assert sum(r["n_rows"] for r in rows) > 0


def test_no_machine_paths_in_sql():
    for sql in entry.oracle_sql().values():
        assert "/root/" not in sql and os.sep + "tmp" not in sql
