from __future__ import annotations

import fleet
import pytest
from fleet import tuples
from pyspark.sql import functions as F

from fleetlens.operators import ranking, uptime_days


@pytest.fixture
def sums(spark, tmp_path):
    """Three increments out of order, one of them stored twice."""
    path = str(tmp_path / "days")
    log = fleet.uptime_log(spark)
    for n in (2, 0, 1, 0):
        uptime_days.add_increment(log.filter(F.expr(f"id div 5 % 3 = {n}")), path, f"part-{n}")
    return path


def test_ranking_equals_the_one_from_checks(spark, sums):
    wanted = tuples(ranking.uptime_ranking(fleet.devices(spark), fleet.uptime_log(spark)))
    assert tuples(uptime_days.ranking_of_days(fleet.devices(spark), uptime_days.stored_days(spark, sums))) == wanted


def test_merged_increments_give_the_same(spark, sums, tmp_path):
    target = str(tmp_path / "merged")
    uptime_days.merge_increments(spark, sums, target)
    merged, parts = uptime_days.stored_days(spark, target), uptime_days.stored_days(spark, sums)
    assert merged.count() == merged.select("day", "device_id").distinct().count() < parts.count()
    totals = [sorted(map(tuple, uptime_days.merged(d, "device_id").collect())) for d in (merged, parts)]
    assert totals[0] == totals[1]


def test_a_ranking_reads_no_checks(spark, sums):
    plan = uptime_days.merged(uptime_days.stored_days(spark, sums), "device_id")._jdf.queryExecution().executedPlan().toString()
    assert "checked_at" not in plan
