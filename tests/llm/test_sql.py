"""Queries that SQL can express give the rows of their SQL on the smallest tables."""

import pytest

from quaywork.llm import queries as llm
from tests.oracle import compare, database

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    said = compare(spark, database(SMALL), name, llm.queries()[name], llm.oracle_sql()[name], SMALL)
    assert said.startswith("ok "), said
