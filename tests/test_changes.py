from __future__ import annotations

import fleet
from fleet import NOW, ago, tuples
from pyspark.sql import functions as F

from fleetlens.operators import alerts, audit, changes, scans
from fleetlens.sources.schemas import HOST_SCAN, SCAN_RESULTS

LATER = ago(hours=-1)


def results(spark, *rows):
    """scan_id, seq, ip, hostname, type, os, family, mac, status, ports"""
    return spark.createDataFrame(list(rows), SCAN_RESULTS)


def by_ip(df):
    return {r.ip_address: r for r in df.collect()}


def test_upsert_overwrites_with_null_and_keeps_manual_fields(spark):
    owned = fleet.devices(spark).withColumn("owner", F.lit("ann"))
    quick = results(spark, (1, 1, "192.168.1.10", None, None, None, None, None, None, None))
    after = by_ip(changes.upsert_devices(owned, quick, LATER))
    row = after["192.168.1.10"]
    assert (row.hostname, row.os_name, row.open_ports) == (None, None, None)
    assert (row.device_type, row.status) == ("Unknown", "online")
    assert (row.id, row.owner, row.department, row.first_seen, row.last_seen) == (2, "ann", "IT", ago(days=2), LATER)
    assert after["192.168.1.11"].last_seen == NOW and len(after) == 13


def test_upsert_can_keep_known_values(spark):
    quick = results(spark, (1, 1, "192.168.1.10", None, "Server", None, None, None, "online", None))
    row = by_ip(changes.upsert_devices(fleet.devices(spark), quick, LATER, keep_known=True))["192.168.1.10"]
    assert (row.hostname, row.os_name, row.last_seen) == ("WIN-SRV-A", "Windows Server 2019", LATER)


def test_last_result_wins_and_new_devices_get_ids_in_address_order(spark):
    batch = results(
        spark,
        (2, 1, "10.0.0.7", "second", None, None, None, None, None, None),
        (1, 9, "10.0.0.7", "first", None, "Ubuntu", "Linux", None, None, "22"),
        (1, 1, "10.0.0.30", "other", "Printer", None, None, "AA", "offline", None),
    )
    after = by_ip(changes.upsert_devices(fleet.devices(spark), batch, LATER))
    seven, thirty = after["10.0.0.7"], after["10.0.0.30"]
    assert (thirty.id, seven.id) == (14, 15)
    assert (seven.hostname, seven.os_name, seven.open_ports, seven.device_type) == ("second", None, None, "Unknown")
    assert (seven.first_seen, seven.last_seen, seven.owner) == (LATER, LATER, None)
    assert (thirty.status, thirty.device_type) == ("offline", "Printer")


def test_upsert_twice_changes_nothing(spark):
    batch = results(
        spark,
        (1, 1, "10.0.0.7", "new", None, None, None, None, None, None),
        (1, 2, "192.168.1.1", "gw", "Router", None, None, None, "online", "22"),
    )
    once = changes.upsert_devices(fleet.devices(spark), batch, LATER)
    twice = changes.upsert_devices(once, batch, LATER)
    assert sorted(tuples(once), key=str) == sorted(tuples(twice), key=str)


def test_ids_start_at_one_on_an_empty_table(spark):
    batch = results(spark, *[(1, i, f"10.0.{i}.1", None, None, None, None, None, None, None) for i in range(30)])
    after = changes.upsert_devices(fleet.frame(spark, "devices", []), batch, LATER)
    by_id = {r.id: r.ip_address for r in after.collect()}
    assert sorted(by_id) == list(range(1, 31))
    assert [by_id[i] for i in range(1, 31)] == sorted(by_id.values())


def test_new_device_alerts_use_the_ids_of_the_upsert(spark):
    batch = results(
        spark,
        (1, 1, "10.0.0.7", None, None, None, None, None, None, None),
        (1, 2, "10.0.0.7", None, None, None, None, None, None, None),
        (1, 3, "192.168.1.1", None, None, None, None, None, None, None),
    )
    found = alerts.new_device_alerts(batch, fleet.devices(spark), LATER).collect()
    assert [(r.device_id, r.alert_type, r.severity, r.is_read, r.created_at) for r in found] == [
        (14, "new_device", "info", False, LATER)
    ]
    assert "10.0.0.7" in found[0].message


def test_new_ids_follow_the_largest_and_repeat(spark):
    rows = spark.createDataFrame([(i % 7, f"m{i % 50}") for i in range(200)], "device_id long, message string")
    found = changes.with_new_ids(rows, fleet.alerts(spark))
    assert sorted(r.id for r in found.collect()) == list(range(5, 205))
    again = changes.with_new_ids(rows.repartition(3), fleet.alerts(spark))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, again.collect()))


def test_apply_status(spark):
    checks = fleet.frame(
        spark,
        "uptime_log",
        [
            (1, 1, ago(minutes=9), True, 1),
            (2, 1, ago(minutes=5), False, None),
            (4, 13, ago(minutes=5), True, 1),
            (3, 13, ago(minutes=5), False, None),
            (5, 999, NOW, True, 1),
        ],
    )
    after = {r.id: (r.status, r.last_seen) for r in changes.apply_status(fleet.devices(spark), checks).collect()}
    before = {r.id: r.last_seen for r in fleet.devices(spark).collect()}
    assert after[1] == ("offline", max(before[1], ago(minutes=9)))
    assert after[13] == ("online", max(filter(None, [before[13], ago(minutes=5)])))
    assert after[2] == ("online", NOW) and len(after) == 13


def test_apply_edits_replaces_with_null(spark):
    noted = fleet.devices(spark).withColumn("notes", F.lit("old"))
    edits = spark.createDataFrame([(2, "eve", "Sales", None)], "id long, owner string, department string, notes string")
    after = {r.id: r for r in changes.apply_edits(noted, edits).collect()}
    assert (after[2].owner, after[2].department, after[2].notes) == ("eve", "Sales", None)
    assert (after[3].department, after[3].notes) == ("IT", "old")


def test_last_seen_never_moves_back(spark):
    devices = fleet.devices(spark).withColumn("last_seen", F.lit(NOW))
    checks = fleet.frame(spark, "uptime_log", [(1, 1, ago(days=90), True, 1)])
    assert {r.last_seen for r in changes.apply_status(devices, checks).collect()} == {NOW}


def test_last_edit_of_a_device_counts(spark):
    schema = "edit_no long, id long, owner string, department string, notes string"
    rows = [(2, 1, "first", "IT", None), (9, 1, "last", None, "n"), (5, 1, "second", "IT", None)]
    for edits in (rows, rows[::-1]):
        edited = changes.apply_edits(fleet.devices(spark), spark.createDataFrame(edits, schema), order="edit_no")
        after = [r for r in edited.collect() if r.id == 1]
        assert [(r.owner, r.department, r.notes) for r in after] == [("last", None, "n")]
    assert edited.count() == fleet.devices(spark).count()


def test_last_outcome_of_a_scan_counts(spark):
    history = fleet.scan_history(spark)
    schema = "id long, devices_found int, status string, at long"
    rows = [(3, 4, "failed", 1), (3, 7, "completed", 2)]
    for outcomes in (rows, rows[::-1]):
        closed = scans.close_scans(history, spark.createDataFrame(outcomes, schema), LATER, order="at")
        assert [(r.status, r.devices_found) for r in closed.filter("id = 3").collect()] == [("completed", 7)]


def test_mark_read(spark):
    acks = spark.createDataFrame([(1,), (1,), (77,)], "alert_id long")
    assert {r.id: r.is_read for r in changes.mark_read(fleet.alerts(spark), acks).collect()} == {
        1: True,
        2: False,
        3: True,
        4: False,
    }
    assert all(r.is_read for r in changes.mark_read(fleet.alerts(spark)).collect())


def test_delete_devices_takes_their_rows_along(spark):
    ids = spark.createDataFrame([(4,), (4,)], "id long")
    left = changes.delete_devices(fleet.devices(spark), fleet.alerts(spark), fleet.uptime_log(spark), ids)
    assert [d.count() for d in left] == [12, 3, 48]


def test_scan_life(spark):
    history = fleet.scan_history(spark)
    asked = spark.createDataFrame(
        [(1, " 10.0.0.1-9 ", None), (2, "10.0.1.1-9", "scheduled")], "request_no long, ip_range string, triggered_by string"
    )
    opened = scans.open_scans(asked, history, NOW)
    assert [tuple(r) for r in opened.orderBy("id").collect()] == [
        (4, "10.0.0.1-9", NOW, None, 0, "running", "manual"),
        (5, "10.0.1.1-9", NOW, None, 0, "running", "scheduled"),
    ]
    outcomes = spark.createDataFrame([(4, 7, "completed"), (5, 3, "failed")], "id long, devices_found int, status string")
    closed = scans.close_scans(history.unionByName(opened), outcomes, LATER)
    assert {r.id: (r.status, r.devices_found, r.finished_at) for r in closed.filter("id > 2").collect()} == {
        3: ("running", 0, None),
        4: ("completed", 7, LATER),
        5: ("failed", 0, LATER),
    }


def hosts(spark):
    rows = [
        (1, 1, "10.0.0.1", "up", "core", {"mac": "AA"}, [("Cisco IOS", 99), ("Linux", 50)],
         {"udp": {53: ("open",)}, "tcp": {443: ("open",), 22: ("open",), 80: ("open",), 25: ("closed",)}}),
        (1, 2, "10.0.0.254", "up", None, {}, [], {}),
        (1, 3, "10.0.0.3", "down", "srv", None, None, None),
        (1, 4, "10.0.0.4", "up", "srv", None, None, None),
        (2, 1, "10.0.0.5", "down", None, None, None, None),
    ]
    return spark.createDataFrame(rows, HOST_SCAN)


def test_flatten_scan(spark):
    found = by_ip(scans.flatten_scan(hosts(spark)))
    core = found["10.0.0.1"]
    assert (core.os_name, core.os_family, core.open_ports) == ("Cisco IOS", "Cisco", "22,80,443,53")
    assert (core.device_type, core.mac_address, core.status) == ("Router", "AA", "online")
    bare = found["10.0.0.254"]
    assert (bare.os_name, bare.open_ports, bare.mac_address, bare.device_type) == (None, None, None, "Router")
    assert found["10.0.0.4"].device_type == "Server" and len(found) == 3


def test_quick_scan_knows_no_ports(spark):
    core = by_ip(scans.flatten_scan(hosts(spark), detailed=False))["10.0.0.1"]
    assert (core.os_name, core.open_ports, core.device_type, core.mac_address) == (None, None, "Unknown", "AA")


def test_scan_summary(spark):
    assert dict(tuples(scans.scan_summary(hosts(spark)))) == {1: 3, 2: 0}
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert dict(tuples(scans.scan_summary(hosts(spark), ids))) == {1: 3, 2: 0, 3: 0}


def test_scan_reaches_the_inventory(spark):
    after = by_ip(changes.upsert_devices(fleet.devices(spark), scans.flatten_scan(hosts(spark)), LATER))
    assert len(after) == 16 and after["10.0.0.1"].open_ports == "22,80,443,53"


def test_alert_wording(spark):
    flips = spark.createDataFrame(
        [(4, NOW, "offline"), (8, NOW, "offline"), (13, NOW, "offline"), (4, NOW, "back_online")],
        "device_id long, checked_at timestamp, alert_type string",
    )
    untyped = fleet.devices(spark).replace({"Unknown": None}, subset=["device_type"])
    found = {(r.device_id, r.alert_type): (r.severity, r.message) for r in alerts.alert_rows(flips, untyped).collect()}
    assert found == {
        (4, "offline"): ("critical", "CRITICAL: Server db-srv-b (192.168.1.12) is not responding!"),
        (8, "offline"): ("warning", "Laptop LAPTOP-3 (192.168.1.22) is offline."),
        (13, "offline"): ("warning", "Device 192.168.1.99 (192.168.1.99) is offline."),
        (4, "back_online"): ("info", "Server db-srv-b (192.168.1.12) is back online."),
    }


def test_audit_rows(spark):
    edits = spark.createDataFrame(
        [(2, "eve", None, 7, "ann")], "id long, owner string, department string, user_id int, username string"
    )
    row = audit.edit_audit_rows(edits, NOW).first()
    assert (row.action, row.entity_type, row.entity_id, row.details) == ("DEVICE_EDIT", "device", 2, "Owner: eve, Dept: None")
    asked = spark.createDataFrame(
        [(" 10.0.0.1-9", True, 7, "ann")], "ip_range string, detailed boolean, user_id int, username string"
    )
    row = audit.scan_audit_rows(asked, NOW).first()
    assert (row.username, row.details, row.created_at) == ("ann", "Detailed scan: 10.0.0.1-9", NOW)


def test_login_audit_rows(spark):
    users = spark.createDataFrame([(1, "ann", True, "admin"), (2, "bob", False, "viewer")], "id long, username string, is_active boolean, role string")
    tries = [("ann", True, "10.0.0.1"), ("ann", False, "10.0.0.2"), ("ann", None, "10.0.0.3"), ("bob", True, None), ("eve", True, "10.0.0.5"), (None, True, "10.0.0.6")]
    tries = spark.createDataFrame(tries, "username string, password_ok boolean, client_ip string")
    found = audit.login_audit_rows(tries, users, NOW).collect()
    assert {(r.user_id, r.action, r.details, r.status, r.ip_address) for r in found} == {
        (1, "LOGIN", "Logged in as admin", "success", "10.0.0.1"),
        (1, "LOGIN_FAILED", "Wrong password", "failed", "10.0.0.2"),
        (1, "LOGIN_FAILED", "Wrong password", "failed", "10.0.0.3"),
        (2, "LOGIN_FAILED", "Inactive user", "failed", None),
        (None, "LOGIN_FAILED", "Unknown user", "failed", "10.0.0.5"),
        (None, "LOGIN_FAILED", "Unknown user", "failed", "10.0.0.6"),
    }


def test_ids_follow_time(spark):
    rows = fleet.alerts(spark).drop("id")
    found = changes.with_new_ids(rows, fleet.alerts(spark), "created_at").orderBy("id").collect()
    assert [r.id for r in found] == [5, 6, 7, 8]
    assert [r.created_at for r in found] == sorted(r.created_at for r in found)


def test_notifications(spark):
    found = alerts.notification_rows(fleet.alerts(spark), fleet.devices(spark)).collect()
    assert {r.alert_id: r.subject for r in found} == {
        1: "ALERT: db-srv-b is OFFLINE",
        2: "ALERT: LAPTOP-3 is OFFLINE",
        3: "ALERT: printer-2 is OFFLINE",
    }


def test_new_ids_of_an_outage_in_one_moment(spark):
    """All alerts share their time; ids follow the device, and no task holds them all."""
    rows = [(i % 500, "offline", f"m{i}", "info", False, NOW) for i in range(3000)]
    schema = "device_id long, alert_type string, message string, severity string, is_read boolean, created_at timestamp"
    alerts = spark.createDataFrame(rows + rows[:1], schema)
    several = {"spark.sql.shuffle.partitions": "6", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in several}
    for k, v in several.items():
        spark.conf.set(k, v)
    try:
        found = changes.with_new_ids(alerts, fleet.alerts(spark), "created_at")
        assert max(r.n for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) < 1500
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    start = fleet.alerts(spark).agg(F.max("id")).first()[0]
    got = sorted((r.id, r.device_id, r.message) for r in found.collect())
    wanted = sorted((r[0], r[2]) for r in rows + rows[:1])
    assert got == [(start + k, d, m) for k, (d, m) in enumerate(wanted, 1)]
