"""Every query of a numbered problem runs on the smallest tables and equals its SQL where it has one."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from test_contract import DATA, differing


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_queries_equal_sql(spark):
    import __spark_entry__ as e
    from lattica.llm import queries

    assert set(queries.QUERIES) <= set(e.queries()) and not differing(spark, queries.QUERIES, queries.SQL)
