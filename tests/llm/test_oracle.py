"""Queries of this package that SQL can express, against their SQL."""

from __future__ import annotations

import pytest
from compare import difference, sql_connection

from fleetlens.llm.oracle import ORACLE_SQL
from fleetlens.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, SF_DIR), sql_connection(SF_DIR), ORACLE_SQL[name]) is None
