from __future__ import annotations

import random

import fleet
import pytest
from fleet import NOW, ago
from pyspark.sql import functions as F

from fleetlens.operators import changes
from fleetlens.operators.alerts import alert_rows
from fleetlens.operators.flips import status_flips
from fleetlens.streaming import monitor, probes


def checks(spark, n=800):
    rng = random.Random(3)
    rows = [(i, 0 if i % 3 == 0 else rng.randrange(1, 14), ago(minutes=5 * (n - i)), rng.random() < 0.6, i % 9) for i in range(n)]
    return fleet.frame(spark, "uptime_log", rows)


@pytest.fixture
def feed(spark, tmp_path):
    """A folder of four probe files in the order of time."""
    folder = str(tmp_path / "feed")
    rows = checks(spark)
    for part in range(4):
        rows.filter((F.col("id") >= part * 200) & (F.col("id") < part * 200 + 200)).coalesce(1).write.mode("append").parquet(folder)
    return folder


def finish(query):
    query.awaitTermination()
    return query


def flip_set(df):
    return {(r.device_id, r.id, r.alert_type) for r in df.collect()}


def stream_flips(spark, feed, tmp_path):
    probes.use_rocksdb(spark)
    found = probes.flip_stream(probes.probe_stream(spark, feed, max_files=1))
    finish(probes.write_stream(found, str(tmp_path / "flips"), str(tmp_path / "checkpoint"), available_now=True))
    return spark.read.schema(probes.FLIP_SCHEMA).parquet(str(tmp_path / "flips"))


def test_log_equals_input(spark, feed, tmp_path):
    stream = probes.probe_stream(spark, feed, max_files=1)
    finish(probes.write_stream(stream, str(tmp_path / "log"), str(tmp_path / "cp"), available_now=True))
    logged = spark.read.parquet(str(tmp_path / "log"))
    assert sorted(map(tuple, logged.collect())) == sorted(map(tuple, checks(spark).collect()))


def test_stateful_flips_equal_batch_and_survive_a_restart(spark, feed, tmp_path):
    found = stream_flips(spark, feed, tmp_path)
    assert flip_set(found) == flip_set(status_flips(checks(spark)))
    state = {r.device_id: r.is_online for r in changes.newest_status(checks(spark)).collect()}
    late = [(9000, 0, NOW, not state[0], None), (9001, 1, ago(days=300), not state[1], None), (9002, 1, NOW, not state[1], None)]
    fleet.frame(spark, "uptime_log", late).coalesce(1).write.mode("append").parquet(feed)
    after = stream_flips(spark, feed, tmp_path)
    news = {(r.device_id, r.id): r.ignored_checks for r in after.filter("id >= 9000").collect()}
    assert news == {(0, 9000): 0, (1, 9002): 1}


def run_monitor(spark, feed, tmp_path, checkpoint="monitor-cp", devices=None, **limit):
    out = str(tmp_path / "monitor")
    stream = probes.probe_stream(spark, feed, **limit)
    finish(monitor.run_monitor(stream, out, str(tmp_path / checkpoint), devices, available_now=True))
    return out


def test_monitor_equals_batch(spark, feed, tmp_path):
    out = run_monitor(spark, feed, tmp_path, max_files=1)
    batch = checks(spark)
    assert flip_set(monitor.monitored_flips(spark, out)) == flip_set(status_flips(batch))
    assert monitor.monitored_log(spark, out).count() == 800
    state = {(r.device_id, r.is_online, r.online_at) for r in monitor.monitored_state(spark, out).collect()}
    assert state == {(r.device_id, r.is_online, r.online_at) for r in changes.newest_status(batch).collect()}
    devices = fleet.devices(spark)
    status = changes.apply_newest_status(devices, monitor.monitored_state(spark, out))
    assert sorted(map(tuple, status.collect())) == sorted(map(tuple, changes.apply_status(devices, batch).collect()))


def test_monitor_takes_a_whole_history_at_once(spark, feed, tmp_path):
    out = run_monitor(spark, feed, tmp_path)
    assert flip_set(monitor.monitored_flips(spark, out)) == flip_set(status_flips(checks(spark)))


def test_monitor_ignores_and_counts_old_checks(spark, feed, tmp_path):
    out = run_monitor(spark, feed, tmp_path, max_files=1)
    state = {r.device_id: r.is_online for r in monitor.monitored_state(spark, out).collect()}
    late = [(9001, 1, ago(days=300), not state[1], None), (9002, 1, NOW, not state[1], None)]
    fleet.frame(spark, "uptime_log", late).coalesce(1).write.mode("append").parquet(feed)
    run_monitor(spark, feed, tmp_path, max_files=1)
    assert [r.id for r in monitor.monitored_flips(spark, out).filter("id >= 9000").collect()] == [9002]
    after = {r.device_id: r for r in monitor.monitored_state(spark, out).collect()}
    assert (after[1].ignored_checks, after[1].checked_at, after[1].is_online) == (1, NOW, not state[1])
    assert after[0].ignored_checks == 0
    assert monitor.monitored_log(spark, out).count() == 802


def test_a_new_checkpoint_goes_on_from_the_last_state(spark, feed, tmp_path):
    out = run_monitor(spark, feed, tmp_path, max_files=1)
    before = flip_set(monitor.monitored_flips(spark, out))
    state = {r.device_id: r for r in monitor.monitored_state(spark, out).collect()}
    later = str(tmp_path / "later")
    fleet.frame(spark, "uptime_log", [(9003, 1, NOW, not state[1].is_online, None)]).coalesce(1).write.parquet(later)
    run_monitor(spark, later, tmp_path, checkpoint="another-cp")
    assert monitor.monitored_log(spark, out).count() == 801
    assert {i for _, i, _ in flip_set(monitor.monitored_flips(spark, out)) - before} == {9003}
    after = {r.device_id: r for r in monitor.monitored_state(spark, out).collect()}
    assert (after[1].id, after[1].is_online) == (9003, not state[1].is_online)
    assert after[0] == state[0] and len(after) == len(state)


def test_monitor_raises_alerts_and_moves_devices_per_batch(spark, feed, tmp_path):
    devices, batch = fleet.devices(spark), checks(spark)
    out = run_monitor(spark, feed, tmp_path, devices=devices, max_files=1)
    wanted = alert_rows(status_flips(batch), devices)
    assert sorted(map(tuple, monitor.monitored_alerts(spark, out).select(wanted.columns).collect())) == sorted(map(tuple, wanted.collect()))
    moved = sorted(map(tuple, monitor.monitored_devices(spark, out).collect()))
    assert moved == sorted(map(tuple, changes.apply_status(devices, batch).collect()))


def test_monitor_writes_the_devices_of_a_batch_only(spark, feed, tmp_path, monkeypatch):
    """Seven batches of few devices after the history, in two starts; the places are used again from the seventh batch on."""
    monkeypatch.setattr(monitor, "FULL_EVERY", 3)
    devices = fleet.devices(spark)
    out = run_monitor(spark, feed, tmp_path, devices=devices)
    known = {r.device_id: r for r in monitor.monitored_state(spark, out).collect()}
    news = [(9000 + i, 1 + i % 2, ago(minutes=-5 * i - 5), i % 3 == 0, i) for i in range(7)]
    for part in (news[:5], news[5:]):
        for row in part:
            fleet.frame(spark, "uptime_log", [row]).coalesce(1).write.mode("append").parquet(feed)
        run_monitor(spark, feed, tmp_path, devices=devices, max_files=1)
    for table, key in (("state", "device_id"), ("devices", "id")):
        written = [(r[key], r.written_by) for r in spark.read.parquet(f"{out}/{table}/1").collect()]
        assert written == [(1, 7)]
    history = checks(spark).unionByName(fleet.frame(spark, "uptime_log", news))
    assert flip_set(monitor.monitored_flips(spark, out)) == flip_set(status_flips(history))
    after = {r.device_id: r for r in monitor.monitored_state(spark, out).collect()}
    assert {d: r for d, r in after.items() if d > 2} == {d: r for d, r in known.items() if d > 2}
    assert (after[1].id, after[2].id) == (9006, 9005)
    moved = sorted(map(tuple, monitor.monitored_devices(spark, out).collect()))
    assert moved == sorted(map(tuple, changes.apply_status(devices, history).collect()))


def test_newest_status_needs_no_sort(spark):
    plan = changes.newest_status(checks(spark))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_repeated_batch_gives_the_same(spark):
    rows = checks(spark, 90)
    empty = spark.createDataFrame([], monitor.STATE)
    flips, state = monitor.step(monitor.mark_old(rows, empty), empty)
    again, after = monitor.step(monitor.mark_old(rows, state), state)
    assert again.count() == 0 and flips.count() > 0
    assert after.select("device_id", "checked_at", "is_online").exceptAll(state.select("device_id", "checked_at", "is_online")).count() == 0


def test_streamed_alerts_join_devices(spark, feed, tmp_path):
    probes.use_rocksdb(spark)
    devices = fleet.devices(spark)
    stream = alert_rows(probes.flip_stream(probes.probe_stream(spark, feed, max_files=1)), devices)
    finish(probes.write_stream(stream, str(tmp_path / "alerts"), str(tmp_path / "cp"), available_now=True))
    found = spark.read.schema(stream.schema).parquet(str(tmp_path / "alerts"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, alert_rows(status_flips(checks(spark)), devices).collect()))


def test_current_status_in_update_mode(spark, feed, tmp_path):
    seen: dict[int, tuple] = {}

    def keep(batch, _):
        seen.update({r.device_id: (r.is_online, r.online_at) for r in batch.collect()})

    stream = probes.current_status(probes.probe_stream(spark, feed, max_files=1))
    query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp"))
    finish(query.trigger(availableNow=True).start())
    assert seen == {r.device_id: (r.is_online, r.online_at) for r in changes.newest_status(checks(spark)).collect()}


@pytest.mark.parametrize("job", [probes.daily_uptime, probes.sliding_uptime])
def test_windows_equal_batch_behind_the_watermark(spark, feed, tmp_path, job):
    """A last check far ahead closes every window of the real ones."""
    far = fleet.frame(spark, "uptime_log", [(9000, 1, ago(days=-60), True, 1)])
    far.coalesce(1).write.mode("append").parquet(feed)
    stream = job(probes.probe_stream(spark, feed, max_files=1))
    finish(probes.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True))
    found = spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, job(checks(spark)).collect()))


def test_daily_alerts_equal_batch(spark, tmp_path):
    folder = str(tmp_path / "alerts")
    rows = fleet.alerts(spark)
    rows.coalesce(1).write.parquet(folder)
    fleet.frame(spark, "alerts", [(99, 1, "offline", "m", "info", False, ago(days=-9))]).coalesce(1).write.mode("append").parquet(folder)
    stream = probes.daily_alerts(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder))
    finish(probes.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True))
    found = spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, probes.daily_alerts(rows).collect()))
