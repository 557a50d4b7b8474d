"""Every registered query against its SQL twin on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.check import compare
from tests.conftest import SMALL

from tidemark.plans import catalog  # the training-data queries are tested in tests/llm

QUERIES, ORACLE = dict(catalog.QUERIES), dict(catalog.ORACLE)

# Queries without a row on the smallest tables, on either side.
EMPTY_ON_SMALL = {"j_06_common_keys", "t_34_cooccurrence_graph", "w_28_bursts", "x_06_burst_stream"}


def test_registry_is_consistent():
    assert set(QUERIES) <= set(queries()) and set(ORACLE) <= set(oracle_sql()) <= set(queries())
    assert set(ORACLE) <= set(QUERIES)
    assert sorted(set(QUERIES) - set(ORACLE)) == ["m_03_fit_multistep", "v_10_project_2d"]


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) == 5 and all(row["close"] > 0 for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    problem = compare(spark, duck, name, QUERIES[name], ORACLE[name], SMALL)
    assert problem is None or (problem == "EMPTY" and name in EMPTY_ON_SMALL), problem


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0
