from __future__ import annotations

import fleet
from fleet import NOW, ago, tuples

from fleetlens.operators import listing, sessions


def test_listing_order_is_status_then_address_text(spark):
    found = [(r.status, r.ip_address) for r in listing.device_listing(fleet.devices(spark)).collect()]
    assert [s for s, _ in found] == ["online"] * 9 + ["offline"] * 3 + ["unknown"]
    online = [ip for s, ip in found if s == "online"]
    assert online == sorted(online)


def test_lookup_by_link_form(spark):
    keys = spark.createDataFrame([("192-168-1-10",), ("192-168-1-10",), ("192.168.1.12",), ("10-0-0-1",)], "ip_address string")
    devices = fleet.devices(spark)
    assert sorted(r.id for r in listing.lookup_devices(devices, keys).collect()) == [2, 4]
    assert tuples(listing.missing_devices(devices, keys)) == [("10.0.0.1",)]


def test_search_inventory(spark):
    devices = fleet.devices(spark)

    def ids(facet, words=""):
        return sorted(r.id for r in listing.search_inventory(devices, facet, words).collect())

    assert ids("offline") == [4, 8, 12]
    assert ids("Printer") == [11, 12]
    assert ids("all", "SRV") == [2, 3, 4, 5]
    assert ids("offline", "fin") == [8, 12]
    assert ids("all", ".99") == [13]
    assert len(ids("all")) == 13


def test_alert_listing_drops_orphans(spark):
    orphan = fleet.frame(spark, "alerts", [(9, 999, "offline", "m", "info", False, NOW)])
    everything = fleet.alerts(spark).unionByName(orphan)
    devices = fleet.devices(spark)
    shown = listing.alert_listing(everything, devices)
    assert [r.id for r in shown.collect()] == [4, 1, 2, 3]
    assert [r.id for r in listing.alert_listing(everything, devices, unread_only=True).collect()] == [4, 1, 2]
    assert [r.id for r in listing.filter_alerts(shown, "warning").collect()] == [2, 3]
    assert [r.id for r in listing.filter_alerts(shown, "unread").collect()] == [4, 1, 2]
    assert [r.id for r in listing.recent_alerts(shown, 2).collect()] == [4, 1]
    one = spark.createDataFrame([("192.168.1.22",), ("192.168.1.22",)], "ip_address string")
    assert [r.id for r in listing.device_alerts(everything, devices, one).collect()] == [2]


def test_offline_devices_are_labelled(spark):
    gone = fleet.devices(spark).replace("unknown", "offline", ["status"])
    found = {r.ip_address: r.hostname for r in listing.offline_devices(gone).collect()}
    assert found["192.168.1.99"] == "Unknown" and found["192.168.1.12"] == "db-srv-b" and len(found) == 4


def audit(spark):
    rows = [
        (1, 1, "Ann", "LOGIN", None, None, "from office", None, "success", ago(minutes=5)),
        (2, 1, "ann", "SCAN_START", None, None, "quick scan", None, "success", ago(minutes=4)),
        (3, 2, "bob", "LOGIN_FAILED", None, None, None, None, "failed", ago(minutes=4)),
        (4, None, None, "LOGIN_FAILED", None, None, "unknown ANN", None, "failed", ago(minutes=1)),
    ]
    return fleet.frame(spark, "audit_logs", rows)


def test_search_audit_filters_before_the_limit(spark):
    rows = audit(spark)
    assert [r.id for r in listing.search_audit(rows).collect()] == [4, 3, 2, 1]
    assert [r.id for r in listing.search_audit(rows, 2).collect()] == [4, 3]
    assert [r.id for r in listing.search_audit(rows, 1, username="ANN").collect()] == [2]
    assert [r.id for r in listing.search_audit(rows, 9, action="LOGIN_FAILED").collect()] == [4, 3]
    assert [r.id for r in listing.search_audit(rows, 9, username="%").collect()] == []


def test_page_filter_sees_fetched_rows_only(spark):
    fetched = listing.search_audit(audit(spark), 2)
    assert [r.id for r in listing.filter_audit(fetched, text="ann").collect()] == [4]
    everything = listing.search_audit(audit(spark), 9)
    assert [r.id for r in listing.filter_audit(everything, text="ann").collect()] == [4, 2, 1]
    assert [r.id for r in listing.filter_audit(everything, "LOGIN", "ann").collect()] == [1]


def test_recent_scans(spark):
    found = [(r.id, r.status_label, r.duration) for r in listing.recent_scans(fleet.scan_history(spark)).collect()]
    assert found == [(3, "Running", None), (2, "Completed", "59s"), (1, "Completed", "3m")]
    assert listing.recent_scans(fleet.scan_history(spark), 2).count() == 2


def test_last_checks(spark):
    uptime, devices = fleet.uptime_log(spark), fleet.devices(spark)
    found = listing.last_checks(uptime, devices, 5, ips=["192.168.1.12"]).orderBy("check_no").collect()
    assert [r.time_of_day for r in found] == ["12:00", "11:00", "10:00", "09:00", "08:00"]
    assert [r.chart_value for r in found] == [0, 8, 8, 8, 8]
    assert listing.last_checks(uptime, devices, 5).count() == 15
    orphan = fleet.frame(spark, "uptime_log", [(999, 999, NOW, True, 1)])
    assert listing.last_checks(uptime.unionByName(orphan), devices, 5).count() == 15


def people(spark):
    rows = [
        (1, "ann", "a@x", "admin", True, None, ago(days=9)),
        (2, "bob", None, "viewer", False, None, ago(days=8)),
        (3, "eve", None, "viewer", True, ago(days=1), ago(days=7)),
    ]
    return fleet.frame(spark, "users", rows)


def test_user_directory(spark):
    users = people(spark)
    assert [r.id for r in listing.user_directory(users).collect()] == [3, 2, 1]
    assert [r.id for r in listing.user_directory(users, names=["bob", "zoe"]).collect()] == [2]
    assert [r.id for r in listing.user_directory(users, ids=[1]).collect()] == [1]


def test_device_ports(spark):
    spaced = fleet.devices(spark).replace("9100,515", " 9100, 515", ["open_ports"])
    found = [r.port for r in listing.device_ports(spaced).filter("id = 11").collect()]
    assert found == ["9100", "515"]
    assert listing.device_ports(spaced).filter("id = 13").count() == 0


def logged_in(spark):
    rows = [
        (1, "live", ago(hours=-1), None, True),
        (1, "last instant", NOW, None, True),
        (1, "expired", ago(seconds=1), None, True),
        (1, "revoked", ago(hours=-1), None, False),
        (2, "inactive user", ago(hours=-1), None, True),
        (9, "no user", ago(hours=-1), None, True),
        (3, "other", ago(hours=-2), None, True),
    ]
    return fleet.frame(spark, "sessions", rows)


def test_live_sessions(spark):
    found = sessions.live_sessions(logged_in(spark), people(spark), NOW)
    assert {r.session_token for r in found.collect()} == {"live", "last instant", "other"}


def test_revoke_sessions(spark):
    tokens = spark.createDataFrame([("other",), ("other",)], "session_token string")
    users = spark.createDataFrame([(2,)], "user_id long")
    after = {r.session_token: r.is_active for r in sessions.revoke_sessions(logged_in(spark), tokens, users).collect()}
    assert len(after) == 7
    assert after == {
        "live": True,
        "last instant": True,
        "expired": True,
        "revoked": False,
        "inactive user": False,
        "no user": True,
        "other": False,
    }


def test_last_login_moves_forward_only(spark):
    rows = [
        (1, 1, "ann", "LOGIN", None, None, None, None, "success", ago(hours=3)),
        (2, 1, "ann", "LOGIN", None, None, None, None, "success", ago(hours=5)),
        (3, 3, "eve", "LOGIN", None, None, None, None, "success", ago(days=3)),
        (4, 2, "bob", "LOGIN_FAILED", None, None, None, None, "failed", ago(hours=1)),
    ]
    after = sessions.apply_last_login(people(spark), fleet.frame(spark, "audit_logs", rows)).collect()
    assert {r.id: r.last_login for r in after} == {1: ago(hours=3), 2: None, 3: ago(days=1)}
