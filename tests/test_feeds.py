"""Streams that are fed in parts: late and repeated checks, closed windows, the cost of a batch."""

from __future__ import annotations

from pathlib import Path

import fleet
from fleet import ago
from pyspark.sql import functions as F

from fleetlens.operators.flips import status_flips
from fleetlens.streaming import feeds, probes


def feed_of(spark, tmp_path, parts):
    """Checks given as (id, device, minutes ago, online) per part."""
    rows = [(i, d, ago(minutes=m), up, 1, n) for n, part in enumerate(parts) for i, d, m, up in part]
    frame = spark.createDataFrame(rows, "id long, device_id long, checked_at timestamp, is_online boolean, response_ms int, n int")
    return feeds.written_in_parts(frame, F.col("n"), str(tmp_path / "feed"))


def run(spark, stream, tmp_path, name="out"):
    probes.use_rocksdb(spark)
    query = probes.write_stream(stream, str(tmp_path / name), str(tmp_path / f"{name}-cp"), available_now=True)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(str(tmp_path / name)), query


def test_parts_come_in_order_one_batch_each(spark, tmp_path):
    feed = feed_of(spark, tmp_path, [[(10 * n + i, i, 1000 - n, True) for i in range(5 + n)] for n in range(4)])
    found, query = run(spark, feed.stream(), tmp_path)
    assert [(part, r["numInputRows"]) for part, r in feed.reports(query)] == [(n, 5 + n) for n in range(4)]
    assert found.count() == 26


def test_large_parts_come_in_several_files(spark, tmp_path):
    rows = spark.range(9000).select("id", (F.col("id") % 2).alias("n"))
    feed = feeds.written_in_parts(rows, F.col("n"), str(tmp_path / "feed"))
    assert (feed.files_per_part, len(list(Path(feed.path).glob("*.parquet")))) == (4, 8)


def test_an_empty_feed_runs(spark, tmp_path):
    found, query = run(spark, feed_of(spark, tmp_path, [[]]).stream(), tmp_path)
    assert found.count() == 0


DAY = 24 * 60


def test_late_and_repeated_checks_are_left_out_and_counted(spark, tmp_path):
    parts = [
        [(1, 1, 20 * DAY, True), (2, 1, 20 * DAY - 1, False)],
        [(3, 1, 15 * DAY, True), (2, 1, 20 * DAY - 1, False)],  # the repeat is known
        [(4, 1, 10 * DAY, True), (5, 1, 20 * DAY - 59, True)],  # 59 minutes behind what was known before
        [(6, 1, 5 * DAY, True), (7, 1, 19 * DAY, True), (3, 1, 15 * DAY, True)],  # late by four days, a repeat
        [(8, 1, 0, True)],
    ]
    feed = feed_of(spark, tmp_path, parts)
    found, query = run(spark, probes.daily_uptime_in_time(feed.stream()), tmp_path)
    assert [feeds.late_rows(r) for _, r in feed.reports(query)] == [0, 0, 0, 1, 0]
    days = [(r.window_start, r.total_checks, r.online_checks) for r in found.collect()]
    assert len({d for d, _, _ in days}) == len(days)  # each closed day comes once
    assert sum(n for _, n, _ in days) == 6 and sum(n for _, _, n in days) == 5  # the last day is still open


def new_bytes(folder, seen):
    files = {p: p.stat().st_size for p in Path(folder).rglob("*") if p.is_file() and "state" in p.parts}
    return sum(size for p, size in files.items() if p not in seen), set(files)


def test_a_batch_writes_state_for_its_own_devices_only(spark, tmp_path):
    feed = str(tmp_path / "feed")

    def arrive(first, n, minutes):
        rows = [(first + i, i, ago(minutes=minutes), (first + i) % 2 == 0, 1) for i in range(n)]
        fleet.frame(spark, "uptime_log", rows).coalesce(1).write.mode("append").parquet(feed)
        run(spark, probes.flip_stream(probes.probe_stream(spark, feed)), tmp_path)

    arrive(0, 20000, 100)
    large, seen = new_bytes(tmp_path / "out-cp", set())
    arrive(20001, 20, 50)
    small, _ = new_bytes(tmp_path / "out-cp", seen)
    assert small < large / 10
    flips = spark.read.parquet(str(tmp_path / "out"))
    assert flips.count() == 20
    history = spark.read.schema(probes.probe_schema()).parquet(feed)
    assert sorted(map(tuple, flips.drop("ignored_checks").collect())) == sorted(map(tuple, status_flips(history).collect()))
