"""The registered queries against their SQL twins; those without one give a row per document."""

import pytest

from tests.check import compare
from tests.conftest import SMALL
from tidemark.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    assert compare(spark, duck, name, QUERIES[name], ORACLE[name], SMALL) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    n = duck.sql("SELECT count(DISTINCT conv_id) + 1 FROM conversations" if name.startswith("op10") else "SELECT count(*) FROM documents").fetchall()[0][0]
    key = "conv_id" if name.startswith("op10") else "doc_id"
    assert got[key].nunique() == n and (len(got) == n or name.startswith("op2"))
