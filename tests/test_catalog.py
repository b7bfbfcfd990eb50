"""Every registered query against its SQL counterpart on the smallest given data."""

from __future__ import annotations

from pathlib import Path

import pytest
from compare import difference, sql_connection

import __spark_entry__ as entry
from fleetlens.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="given data not present")


@pytest.fixture(scope="module")
def con():
    return sql_connection(SF_DIR)


@pytest.mark.parametrize("name", catalog.queries())
def test_query_equals_sql(spark, con, name):
    assert difference(entry.queries()[name](spark, SF_DIR), con, entry.oracle_sql()[name]) is None


def test_every_query_has_sql():
    assert catalog.queries().keys() <= entry.oracle_sql().keys() <= entry.queries().keys()


def test_known_numbers_of_flips(spark):
    found = entry.queries()["status_flips"](spark, SF_DIR).groupBy("alert_type").count().collect()
    assert {r.alert_type: r["count"] for r in found} == {"offline": 158, "back_online": 162}


def test_flagship(spark):
    assert entry.entry(spark).count() == 15


def test_sliding_stream_has_the_windows_open_at_the_end(spark):
    streamed, batch = (entry.queries()[name](spark, SF_DIR) for name in ("stream_sliding_uptime", "sliding_uptime"))
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.select(streamed.columns).collect()))
