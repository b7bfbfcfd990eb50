from __future__ import annotations

import random

import fleet
import pytest
from fleet import NOW, ago
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.operators.flips import status_flips


@pytest.fixture(scope="module")
def history(spark):
    """Forty days of checks; device 0 holds a third of them. Some share their instant."""
    rng = random.Random(7)
    rows = []
    for i in range(4000):
        device = 0 if i % 3 == 0 else rng.randrange(1, 30)
        rows.append((i, device, ago(minutes=15 * rng.randrange(0, 3840)), rng.random() < 0.7, None))
    return fleet.frame(spark, "uptime_log", rows).cache()


def plain(df):
    before = F.lag("is_online").over(Window.partitionBy("device_id").orderBy("checked_at", "id"))
    return df.withColumn("before", before).filter("before <> is_online")


@pytest.mark.parametrize("chunk", ["minute", "hour", "day", "month", "year"])
def test_flips_equal_the_plain_window(history, chunk):
    """From one check in most chunks to one chunk in all."""
    found = {(r.device_id, r.id, r.alert_type) for r in status_flips(history, None, chunk).collect()}
    wanted = {(r.device_id, r.id, "back_online" if r.is_online else "offline") for r in plain(history).collect()}
    assert found == wanted and len(found) > 1000


def test_flips_alternate(history):
    order = Window.partitionBy("device_id").orderBy("checked_at", "id")
    repeated = status_flips(history).withColumn("before", F.lag("alert_type").over(order)).filter("before = alert_type")
    assert repeated.count() == 0


def test_no_window_runs_over_a_whole_heavy_device(history):
    """Checks are compared inside (device, chunk); the window per device sees two rows per chunk."""
    found = status_flips(history)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    over_rows = [line for line in plan.splitlines() if "lag(is_online" in line and "windowspecdefinition" in line]
    assert over_rows and all("_chunk" in line.split("windowspecdefinition")[1] for line in over_rows)


def test_first_check_is_silent_unless_the_state_is_known(spark):
    checks = fleet.frame(spark, "uptime_log", [(1, 1, NOW, False, None), (2, 2, NOW, False, None), (3, 3, NOW, True, 1)])
    assert status_flips(checks).count() == 0
    known = spark.createDataFrame([(1, True), (2, False), (3, False)], "device_id long, is_online boolean")
    found = {(r.device_id, r.alert_type) for r in status_flips(checks, known).collect()}
    assert found == {(1, "offline"), (3, "back_online")}
