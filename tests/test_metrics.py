from __future__ import annotations

import fleet
import pytest
from fleet import NOW, ago, tuples

from fleetlens.operators import metrics, ranking
from fleetlens.plans.dashboard import dashboard_stats


def test_status_counts(spark):
    assert tuples(metrics.status_counts(fleet.devices(spark))) == [(13, 9, 3, 1)]


def test_status_counts_of_nothing_are_zero(spark):
    empty = fleet.frame(spark, "devices", [])
    assert tuples(metrics.status_counts(empty)) == [(0, 0, 0, 0)]


def test_other_status_counts_in_total_only(spark):
    odd = fleet.devices(spark).replace("unknown", "retired", ["status"])
    assert tuples(metrics.status_counts(odd)) == [(13, 9, 3, 0)]


def test_devices_by_type_and_os(spark):
    devices = fleet.devices(spark)
    assert tuples(metrics.devices_by_type(devices)) == [
        ("Laptop", 5),
        ("Server", 4),
        ("Printer", 2),
        ("Router", 1),
        ("Unknown", 1),
    ]
    assert dict(tuples(metrics.devices_by_os(devices))) == {"Windows": 5, "Linux": 3, "Other": 3, "Cisco": 1}


def test_dashboard_stats(spark):
    found = {(s, n): c for s, n, c in tuples(dashboard_stats(fleet.devices(spark), fleet.alerts(spark)))}
    assert found[("total", "total")] == 13 and found[("total", "unknown")] == 1
    assert found[("by_type", "Server")] == 4 and found[("by_os", "Windows")] == 5
    assert ("by_os", None) not in found
    assert found[("alerts", "unread")] == 3


def test_dashboard_of_empty_tables(spark):
    stats = dashboard_stats(fleet.frame(spark, "devices", []), fleet.frame(spark, "alerts", []))
    assert {c for _, _, c in tuples(stats)} == {0} and stats.count() == 5


def test_department_share(spark):
    found = tuples(metrics.department_share(fleet.devices(spark)))
    assert found[0] == ("IT", 5, 4, 1, 38.5)
    assert {r[0]: r[4] for r in found} == {
        "IT": 38.5,
        "HR": 23.1,
        "Finance": 15.4,
        "Development": 15.4,
        "Unassigned": 7.7,
    }


def test_department_label_does_not_merge_groups(spark):
    """NULL, '' and a department spelled like the label stay three groups."""
    rows = [
        (i, f"10.0.0.{i}", None, None, None, None, None, None, dept, "online", None, None, NOW, None)
        for i, dept in enumerate([None, "", "Unassigned"], 1)
    ]
    found = tuples(metrics.department_share(fleet.frame(spark, "devices", rows)))
    assert sorted(r[0] for r in found) == ["", "Unassigned", "Unassigned"]


def test_alert_analysis(spark):
    found = {r.alert_type: r for r in metrics.alert_analysis(fleet.alerts(spark)).collect()}
    down = found["offline"]
    assert (down.total, down.critical, down.warnings, down.infos, down.unread) == (3, 1, 2, 0, 2)
    assert (down.first_alert, down.last_alert) == (ago(hours=5), ago(minutes=45))
    assert (found["new_device"].infos, found["new_device"].type_label) == (1, "New Device")


def test_uptime_ranking(spark):
    found = ranking.uptime_ranking(fleet.devices(spark), fleet.uptime_log(spark)).collect()
    assert [(r.ip_address, r.uptime_pct, r.rank_uptime, r.quartile, r.band) for r in found] == [
        ("192.168.1.10", 100.0, 1, 1, "good"),
        ("192.168.1.11", 100.0, 1, 2, "good"),
        ("192.168.1.12", 95.8, 3, 3, "good"),
    ]


def test_device_uptime_keeps_unchecked_devices(spark):
    found = {r.id: r for r in ranking.device_uptime(fleet.devices(spark), fleet.uptime_log(spark)).collect()}
    assert len(found) == 13
    assert (found[1].total_checks, found[1].uptime_pct, found[1].avg_response_ms) == (0, None, None)
    assert (found[3].total_checks, found[3].avg_response_ms) == (24, 0.0)
    assert (found[4].online_checks, found[4].uptime_pct) == (23, 95.8)


def kpi(spark, days):
    tables = [t(spark) for t in (fleet.uptime_log, fleet.devices, fleet.alerts, fleet.scan_history)]
    return tuples(metrics.period_kpi(*tables, as_of=NOW, days=days))


def test_period_kpi(spark):
    assert kpi(spark, 30) == [(98.6, 13, 4, 3)]


def test_period_kpi_lower_bound_counts(spark):
    """A scan exactly one day old is inside a one-day period."""
    assert kpi(spark, 1) == [(98.6, 13, 4, 3)]


def test_period_kpi_without_checks(spark):
    empty = fleet.frame(spark, "uptime_log", [])
    tables = [t(spark) for t in (fleet.devices, fleet.alerts, fleet.scan_history)]
    assert tuples(metrics.period_kpi(empty, *tables, as_of=NOW, days=7))[0][0] == 0.0


def test_kpi_weighs_devices_not_checks(spark):
    """100 % over one check and 0 % over three checks give 50, not 25."""
    rows = [(1, 1, NOW, True, 1)] + [(i, 2, NOW, False, None) for i in (2, 3, 4)]
    tables = [t(spark) for t in (fleet.devices, fleet.alerts, fleet.scan_history)]
    found = metrics.period_kpi(fleet.frame(spark, "uptime_log", rows), *tables, as_of=NOW, days=1)
    assert tuples(found)[0][0] == 50.0


def test_daily_activity_skips_idle_days(spark):
    scans = fleet.frame(
        spark, "scan_history", [(i, "r", ago(days=d), None, 0, "running", None) for i, d in enumerate([0, 0, 5], 1)]
    )
    alerts = fleet.frame(
        spark, "alerts", [(i, 1, "offline", "m", "info", False, ago(days=d)) for i, d in enumerate([5, 5, 2, 40], 1)]
    )
    found = [(r.day.day, r.scans, r.alerts, r.prev_day_alerts) for r in metrics.daily_activity(scans, alerts, NOW, 30).collect()]
    assert found == [(1, 2, 0, 1), (29, 0, 1, 2), (26, 1, 2, None)]


def test_device_growth(spark):
    found = tuples(metrics.device_growth(fleet.devices(spark)))
    assert [(d.day, n, c, g) for d, n, c, g in found] == [(1, 4, 13, 44.4), (30, 5, 9, 125.0), (29, 4, 4, None)]


def test_user_activity_groups_on_stored_name(spark):
    rows = [
        (i, None, name, "LOGIN", None, None, None, None, status, NOW)
        for i, (name, status) in enumerate(
            [("ann", "success"), ("ann", "failed"), ("bob", "success"), ("eve", "success"), (None, "success"), (None, "failed")]
        )
    ]
    found = metrics.user_activity(fleet.frame(spark, "audit_logs", rows)).collect()
    assert {(r.username, r.n_actions, r.n_failed, r.rank_in_action) for r in found} == {
        ("anonymous", 2, 1, 1),
        ("ann", 2, 1, 1),
        ("bob", 1, 0, 3),
        ("eve", 1, 0, 3),
    }


def test_recent_uptime_summary_leaves_out_zero_responses(spark):
    found = {r.device_id: r for r in metrics.recent_uptime_summary(fleet.uptime_log(spark), fleet.devices(spark)).collect()}
    assert (found[3].checks, found[3].uptime_pct, found[3].avg_ms) == (24, 100, None)
    assert (found[4].uptime_pct, found[4].avg_ms) == (96, 8)
    assert (found[1].checks, found[1].uptime_pct) == (0, 0)


def test_check_round_summary(spark):
    found = metrics.check_round_summary(fleet.uptime_log(spark)).orderBy("round_start").collect()
    assert len(found) == 24
    assert (found[-1].online, found[-1].offline) == (2, 1)


def test_audit_headline_covers_fetched_rows_only(spark):
    rows = [(i, 1, "ann", "LOGIN" if i < 5 else "SCAN_START", None, None, None, None, "success", ago(minutes=i)) for i in range(9)]
    found = metrics.audit_headline(fleet.frame(spark, "audit_logs", rows), n=6)
    assert tuples(found) == [(6, 5, 0, 1)]


@pytest.mark.parametrize("part,whole,expected", [(1, 16, 6.3), (927, 2000, 46.4), (0, 7, 0.0), (7, 7, 100.0), (1, 3, 33.3)])
def test_percent_rounds_half_up(spark, part, whole, expected):
    from pyspark.sql import functions as F

    from fleetlens.functions.numbers import percent

    assert spark.range(1).select(percent(F.lit(part), F.lit(whole))).first()[0] == expected
