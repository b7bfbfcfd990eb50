"""The registered queries: every operator over the whole tables of one data directory."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions import rules
from fleetlens.functions.clock import days_before, type_of
from fleetlens.operators import alerts as alert_ops
from fleetlens.operators import audit, changes, flips, listing, metrics, ranking, scans, sessions, uptime_days
from fleetlens.plans.dashboard import dashboard_stats
from fleetlens.session import scratch_dir, settled
from fleetlens.sources import constraints, exports, tables
from fleetlens.sources.derived import AS_OF_EVENTS, AS_OF_ORDERS, GIVEN, Fleet, alerts_of, checks_of
from fleetlens.streaming import feeds, monitor, probes

Query = Callable[[SparkSession, str], DataFrame]
#: Parts in which checks arrive at the monitoring loop, and files of a part that go into one batch.
PARTS = 4
EVERY_FILE = 2**31 - 1
#: Response times from which a check comes in late.
SLOW_MS, SLOWEST_MS = 30, 60


def plain_times(df: DataFrame) -> DataFrame:
    """Timestamps without zone, as the given tables store them (the session zone is UTC)."""
    zoned = {
        f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)
    }
    return df.withColumns(zoned) if zoned else df


# Sources and sinks


def load_table(f: Fleet) -> DataFrame:
    path = scratch_dir(f.spark, "uptime_log")
    tables.append_table(f.uptime_log, path, "uptime_log", AS_OF_EVENTS)
    return plain_times(tables.load_table(f.spark, path, "uptime_log"))


def load_since(f: Fleet) -> DataFrame:
    """Checks of the last week from a table stored by day; earlier days are not read."""
    path = scratch_dir(f.spark, "uptime_log")
    tables.append_table(f.uptime_log, path, "uptime_log", AS_OF_EVENTS, by_day=True)
    return plain_times(tables.load_table(f.spark, path, "uptime_log", since="2024-01-24 00:00:00"))


def load_csv(f: Fleet) -> DataFrame:
    """All alerts from CSV files with the fixed schema."""
    path = scratch_dir(f.spark, "alerts-csv")
    f.alerts.write.option("header", True).csv(path)
    return plain_times(tables.load_table(f.spark, path, "alerts", fmt="csv"))


def written_host_scan(f: Fleet) -> str:
    """The nested scan as JSON lines; what hosts without a name sent was cut off half way."""
    path = scratch_dir(f.spark, "host-scan")
    line = F.to_json(F.struct(*f.host_scan.columns))
    cut = F.substring(line, F.lit(1), F.length(line).cast("int") - F.lit(20))
    f.host_scan.select(F.when(F.col("hostname").isNull(), cut).otherwise(line).alias("value")).write.text(path)
    return path


def load_host_scan(f: Fleet) -> DataFrame:
    return scans.flatten_scan(tables.load_host_scan(f.spark, written_host_scan(f)))


def host_scan_rejects(f: Fleet) -> DataFrame:
    """Addresses in the lines that could not be read, with the reason."""
    address = F.regexp_extract("line", '"ip_address":"([^"]*)"', 1).alias("ip_address")
    return tables.host_scan_rejects(f.spark, written_host_scan(f)).select(address, "reason")


def append_repeated(f: Fleet) -> DataFrame:
    """Old alerts, then those of all status changes, each appended twice under the name of its batch."""
    path = scratch_dir(f.spark, "alerts")
    found = settled(alert_ops.alert_rows(flips.status_flips(f.uptime_log), f.devices))
    fresh = settled(changes.with_new_ids(found, f.alerts, "created_at"))
    for rows, batch in ((f.alerts, "old"), (fresh, "changes"), (fresh, "changes"), (f.alerts, "old")):
        tables.append_table(rows, path, "alerts", AS_OF_EVENTS, batch=batch)
    return plain_times(tables.load_table(f.spark, path, "alerts"))


def export_csv(f: Fleet) -> DataFrame:
    """The inventory as CSV, read back with the place of each row."""
    path = scratch_dir(f.spark, "inventory-csv")
    exports.export_inventory_csv(f.devices, path)
    return exports.load_inventory_csv(f.spark, path)


def append_table(f: Fleet) -> DataFrame:
    """Alerts of all status changes, given new ids, appended to a table stored by day and read back."""
    path = scratch_dir(f.spark, "alerts")
    found = settled(alert_ops.alert_rows(flips.status_flips(f.uptime_log), f.devices))
    tables.append_table(changes.with_new_ids(found, f.alerts, "created_at"), path, "alerts", AS_OF_EVENTS, by_day=True)
    stored = plain_times(tables.load_table(f.spark, path, "alerts"))
    return stored.select("id", "device_id", "alert_type", "message", "severity", "is_read", "created_at")


def audit_constraints(f: Fleet) -> DataFrame:
    """The rules of all tables, as if offline devices and inactive users had been deleted without their rows."""
    parents = {"devices": f.devices.filter("status <> 'offline'"), "users": f.users.filter("is_active")}
    names = ("devices", "scan_history", "alerts", "uptime_log", "users", "sessions", "audit_logs")
    return constraints.audit_tables({t: getattr(f, t) for t in names}, parents)


def fill_defaults(f: Fleet) -> DataFrame:
    """Devices that are not online have lost their status and first time, and get the defaults."""
    online = F.col("status") == "online"
    lost = f.devices.withColumns({c: F.when(online, F.col(c)) for c in ("first_seen", "status")})
    return tables.fill_defaults(lost, "devices", AS_OF_ORDERS)


def table_counts(f: Fleet) -> DataFrame:
    return tables.table_counts({t: getattr(f, t) for t in ("devices", "scan_history", "alerts", "uptime_log")})


# Lookups


def link_form(f: Fleet) -> DataFrame:
    """Scanned addresses as they stand in links."""
    return f.scan_results.select(F.translate("ip_address", ".", "-").alias("ip_address"))


def device_alerts(f: Fleet) -> DataFrame:
    down = f.devices.filter(F.col("status") == "offline")
    return listing.device_alerts(f.alerts, f.devices, down)


# Rules


def typed_by_name(f: Fleet) -> DataFrame:
    kind = rules.device_type_basic(F.col("hostname"), F.col("ip_address"))
    return f.devices.select("id", "hostname", "ip_address", kind.alias("device_type"))


def typed_by_ports(f: Fleet) -> DataFrame:
    ports = rules.numeric_ports(F.col("open_ports"))
    kind = rules.device_type_advanced(F.col("hostname"), F.col("ip_address"), ports, F.col("os_name"))
    return f.devices.select("id", "hostname", "ip_address", kind.alias("device_type"))


def typed_in_sql(f: Fleet) -> DataFrame:
    """Both text rules, called by name in SQL."""
    rules.register_sql_functions(f.spark)
    query = """SELECT id, os_family(os_name) AS os_family, device_type_basic(hostname, ip_address) AS device_type
               FROM {devices}"""
    return f.spark.sql(query, devices=f.devices)


# Rankings from stored sums


def ranking_of_days(f: Fleet) -> DataFrame:
    """The ranking from daily sums that were kept up week by week as checks came in, late ones and a repeat included."""
    path = scratch_dir(f.spark, "uptime-days")
    arrived = settled(f.uptime_log.withColumn("week", week_of(arrival())))
    weeks = [r["week"] for r in arrived.select("week").distinct().orderBy("week").collect()]
    for week in [*weeks, *weeks[:1]]:
        uptime_days.add_increment(arrived.filter(F.col("week") == F.lit(week)), path, str(week))
    return uptime_days.ranking_of_days(f.devices, uptime_days.stored_days(f.spark, path))


def arrival() -> Column:
    """When a check comes in: a slow one half an hour later, the slowest after ten days."""
    slow, at = F.col("response_ms"), F.col("checked_at")
    delayed = F.when(slow >= SLOWEST_MS, at + F.expr("INTERVAL 10 DAYS")).when(slow >= SLOW_MS, at + F.expr("INTERVAL 30 MINUTES"))
    return delayed.otherwise(at)


def week_of(moment: Column) -> Column:
    return F.date_trunc("week", moment).cast("date")


# Changes


def new_ids(f: Fleet) -> DataFrame:
    found = changes.last_result_per_address(f.scan_results)
    return changes.unseen_devices(f.devices, found).select("id", "ip_address")


def open_scans(f: Fleet) -> DataFrame:
    requests = f.source("supplier").selectExpr(
        "s_suppkey AS request_no",
        "concat(' 10.', s_suppkey % 256, '.0.1-254 ') AS ip_range",
        "CAST(NULL AS STRING) AS triggered_by",
    )
    return scans.open_scans(requests, f.scan_history, AS_OF_ORDERS)


def edit_audit_rows(f: Fleet) -> DataFrame:
    """The edits, those without notes as edits that remove the owner."""
    owner = F.when(F.col("notes").isNotNull(), F.col("owner"))
    edits = f.device_edits.withColumns({"user_id": F.lit(1), "username": F.lit("user_1"), "owner": owner})
    return plain_times(audit.edit_audit_rows(edits, AS_OF_EVENTS))


def scan_audit_rows(f: Fleet) -> DataFrame:
    """Every scan of the history as if requested again by an administrator; manual ones are detailed."""
    asked = f.scan_history.withColumns(
        {"detailed": F.col("triggered_by") == "manual", "user_id": F.lit(10), "username": F.lit(None).cast("string")}
    )
    return plain_times(audit.scan_audit_rows(asked, AS_OF_ORDERS))


def by_first_user(df: DataFrame) -> DataFrame:
    return df.withColumns({"user_id": F.lit(1), "username": F.lit("user_1")})


def view_audit_rows(f: Fleet) -> DataFrame:
    """Every scanned address, viewed through its link by a user from that address."""
    views = link_form(f).select(F.col("ip_address").alias("address"), F.translate("ip_address", "-", ".").alias("client_ip"))
    return plain_times(audit.view_audit_rows(by_first_user(views), AS_OF_EVENTS))


def export_audit_rows(f: Fleet) -> DataFrame:
    """The inventory, exported in both forms."""
    counted = f.devices.agg(F.count(F.lit(1)).alias("n_rows"))
    exported = counted.select("n_rows", F.explode(F.array(F.lit("excel"), F.lit("csv"))).alias("form"))
    return plain_times(audit.export_audit_rows(by_first_user(exported), AS_OF_EVENTS))


def login_audit_rows(f: Fleet) -> DataFrame:
    """Every logged login attempt once more; what failed had a wrong password."""
    attempts = f.audit_logs.filter(F.col("action").isin("LOGIN", "LOGIN_FAILED"))
    attempts = attempts.select("username", (F.col("action") == "LOGIN").alias("password_ok"), F.col("ip_address").alias("client_ip"))
    return plain_times(audit.login_audit_rows(attempts, f.users, AS_OF_EVENTS))


def logout_audit_rows(f: Fleet) -> DataFrame:
    """Every live session ends."""
    ended = live_sessions(f).select("user_id", "username")
    return plain_times(audit.logout_audit_rows(ended, AS_OF_EVENTS))


def revoke_sessions(f: Fleet) -> DataFrame:
    """Log out every expired token and every inactive user."""
    expired = f.sessions.filter(F.col("expires_at") < days_before(AS_OF_EVENTS, 10, type_of(f.sessions, "expires_at")))
    inactive = f.users.filter(~F.col("is_active")).select(F.col("id").alias("user_id"))
    return sessions.revoke_sessions(f.sessions, expired, inactive)


def live_sessions(f: Fleet) -> DataFrame:
    ten_days_back = "2024-01-21 00:00:00"
    return sessions.live_sessions(f.sessions, f.users, ten_days_back)


def delete_devices(f: Fleet) -> DataFrame:
    """Rows that remain after removing every offline device."""
    down = f.devices.filter(F.col("status") == "offline")
    remaining = changes.delete_devices(f.devices, f.alerts, f.uptime_log, down)
    names = ("devices", "alerts", "uptime_log")
    return reduce(DataFrame.unionByName, [d.select(F.lit(n).alias("table_name"), "id") for n, d in zip(names, remaining)])


# Streams. Each runs to the end of the given files and returns what it stored.


def stream_source(f: Fleet, name: str) -> DataFrame:
    """A given table as a stream of files; the pattern finds a single file as well as a folder."""
    return f.spark.readStream.schema(GIVEN[name]).parquet(f"{f.sf_dir}/{name}.parquet*")


def zoned(df: DataFrame, column: str) -> DataFrame:
    """Event time as a timestamp with zone, which watermarks ask for."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def streamed_checks(f: Fleet) -> DataFrame:
    return zoned(checks_of(stream_source(f, "events")), "checked_at")


def stored(f: Fleet, stream: DataFrame, purpose: str) -> DataFrame:
    folder = scratch_dir(f.spark, purpose)
    probes.use_rocksdb(f.spark)
    query = probes.write_stream(stream, f"{folder}/rows", f"{folder}/checkpoint", available_now=True)
    query.awaitTermination()
    return plain_times(f.spark.read.schema(stream.schema).parquet(f"{folder}/rows"))


def updated(f: Fleet, stream: DataFrame, keys: list[str], purpose: str) -> DataFrame:
    folder = scratch_dir(f.spark, purpose)
    probes.use_rocksdb(f.spark)
    probes.write_updates(stream, f"{folder}/rows", f"{folder}/checkpoint", available_now=True).awaitTermination()
    return probes.newest_updates(f.spark, f"{folder}/rows", stream.schema, keys)


def streamed_days(f: Fleet) -> DataFrame:
    return updated(f, probes.daily_uptime(streamed_checks(f)), ["device_id", "window_start"], "daily-uptime")


def streamed_alert_days(f: Fleet) -> DataFrame:
    alerts = zoned(alerts_of(stream_source(f, "orders")), "created_at")
    return updated(f, probes.daily_alerts(alerts), ["window_start", "alert_type", "severity"], "daily-alerts")


def monitored(f: Fleet) -> str:
    """The monitoring loop over all checks, which arrive in parts by time; each part is a batch of a new start."""
    folder = scratch_dir(f.spark, "monitor")
    checks = zoned(f.uptime_log, "checked_at")
    cuts = checks.agg(F.percentile_approx("checked_at", [i / PARTS for i in range(1, PARTS)]).alias("v")).first()["v"]
    at = F.col("checked_at")
    for low, high in zip([None, *(cuts or [])], [*(cuts or []), None], strict=True):
        part = checks.filter((at > low) if low else F.lit(True)).filter((at <= high) if high else F.lit(True))
        part.write.mode("append").parquet(f"{folder}/feed")
        arrived = probes.probe_stream(f.spark, f"{folder}/feed", max_files=EVERY_FILE)
        query = monitor.run_monitor(arrived, f"{folder}/rows", f"{folder}/checkpoint", f.devices, available_now=True)
        query.awaitTermination()
    return f"{folder}/rows"


def monitor_status(f: Fleet) -> DataFrame:
    return monitor.monitored_devices(f.spark, monitored(f)).select("id", "status", "last_seen")


def in_weeks(
    f: Fleet,
    rows: DataFrame,
    arrived: Column,
    stream_of: Callable[[DataFrame], DataFrame],
    purpose: str,
    end_of: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, list]:
    """What a stream appends while rows come in week by week, and what its micro-batches report.

    ``end_of`` makes of all rows those of a last part, after the weeks.
    """
    folder = scratch_dir(f.spark, purpose)
    probes.use_rocksdb(f.spark)
    feed = feeds.written_in_parts(rows, week_of(arrived), folder)
    if end_of:
        feed.end_with(end_of(f.spark.read.schema(rows.schema).parquet(feed.path)))
    stream = stream_of(feed.stream())
    query = probes.write_stream(stream, f"{folder}/rows", f"{folder}/checkpoint", available_now=True)
    query.awaitTermination()
    return plain_times(f.spark.read.schema(stream.schema).parquet(f"{folder}/rows")), feed.reports(query)


def stream_flips(f: Fleet) -> DataFrame:
    """Status changes by state of each device, over micro-batches of a week."""
    found, _ = in_weeks(f, zoned(f.uptime_log, "checked_at"), F.col("checked_at"), probes.flip_stream, "flips")
    return found.drop("ignored_checks")


def stream_alerts(f: Fleet) -> DataFrame:
    """Alerts made in the running stream, whose changes meet the inventory there."""
    devices = settled(f.devices.select("id", "ip_address", "hostname", "device_type"))

    def alerts_in(stream: DataFrame) -> DataFrame:
        return alert_ops.alert_rows(probes.flip_stream(stream), devices)

    return in_weeks(f, zoned(f.uptime_log, "checked_at"), F.col("checked_at"), alerts_in, "alerts")[0]


def stream_status(f: Fleet) -> DataFrame:
    """The inventory after the current status of every device, which a stream in update mode keeps."""
    folder = scratch_dir(f.spark, "status")
    probes.use_rocksdb(f.spark)
    checks = zoned(f.uptime_log, "checked_at")
    status = probes.current_status(feeds.written_in_parts(checks, week_of(F.col("checked_at")), folder).stream())
    probes.write_updates(status, f"{folder}/rows", f"{folder}/checkpoint", available_now=True).awaitTermination()
    newest = probes.newest_updates(f.spark, f"{folder}/rows", status.schema, ["device_id"])
    return changes.apply_newest_status(f.devices, newest).select("id", "status", "last_seen")


def stream_sliding_uptime(f: Fleet) -> DataFrame:
    """Seven days of every device, moved on by a day: sums of days, then of windows, both in the stream's state.

    A closing check ends the feed, so the windows that are still open after its last week come out too.
    """
    checks = zoned(f.uptime_log, "checked_at")
    return in_weeks(f, checks, F.col("checked_at"), probes.sliding_uptime, "sliding-uptime", probes.closing_check)[0]


def late_feed(f: Fleet) -> DataFrame:
    """Checks as they come in: slow ones late, offline ones once more after two days."""
    first = f.uptime_log.withColumn("arrived_at", arrival())
    again = first.filter(~F.col("is_online")).withColumn("arrived_at", F.col("arrived_at") + F.expr("INTERVAL 2 DAYS"))
    return zoned(first.unionByName(again), "checked_at")


def late_days(f: Fleet) -> tuple[DataFrame, list]:
    return in_weeks(f, late_feed(f), F.col("arrived_at"), probes.daily_uptime_in_time, "days-in-time")


def stream_late_checks(f: Fleet) -> DataFrame:
    """Per week of arrival how many checks came in and how many of them were left out as too late."""
    rows = [(week, report["numInputRows"], feeds.late_rows(report)) for week, report in late_days(f)[1]]
    return f.spark.createDataFrame(rows, "week date, n_checks bigint, n_late bigint")


CATALOG: dict[str, Callable[[Fleet], DataFrame]] = {
    "uptime_ranking": lambda f: ranking.uptime_ranking(f.devices, f.uptime_log),
    "device_uptime": lambda f: ranking.device_uptime(f.devices, f.uptime_log),
    # counts and indicators
    "status_counts": lambda f: metrics.status_counts(f.devices),
    "devices_by_type": lambda f: metrics.devices_by_type(f.devices),
    "devices_by_os": lambda f: metrics.devices_by_os(f.devices),
    "unread_alert_count": lambda f: metrics.unread_alert_count(f.alerts),
    "dashboard_stats": lambda f: dashboard_stats(f.devices, f.alerts),
    "period_kpi": lambda f: metrics.period_kpi(f.uptime_log, f.devices, f.alerts, f.scan_history, AS_OF_EVENTS, 7),
    "period_kpi_orders": lambda f: metrics.period_kpi(
        f.uptime_log, f.devices, f.alerts, f.scan_history, AS_OF_ORDERS, 90
    ),
    "daily_activity": lambda f: metrics.daily_activity(f.scan_history, f.alerts, AS_OF_ORDERS, 90),
    "department_share": lambda f: metrics.department_share(f.devices),
    "alert_analysis": lambda f: metrics.alert_analysis(f.alerts),
    "device_growth": lambda f: metrics.device_growth(f.devices),
    "user_activity": lambda f: metrics.user_activity(f.audit_logs),
    "audit_headline": lambda f: metrics.audit_headline(f.audit_logs),
    "recent_uptime_summary": lambda f: metrics.recent_uptime_summary(f.uptime_log, f.devices),
    "check_round_summary": lambda f: metrics.check_round_summary(f.uptime_log),
    # listings and lookups
    "device_listing": lambda f: listing.device_listing(f.devices),
    "lookup_devices": lambda f: listing.lookup_devices(f.devices, link_form(f)),
    "missing_devices": lambda f: listing.missing_devices(f.devices, link_form(f)),
    "search_inventory": lambda f: listing.search_inventory(f.devices, "Server", "SRV"),
    "search_inventory_status": lambda f: listing.search_inventory(f.devices, "online", "10.1"),
    "alert_listing": lambda f: listing.alert_listing(f.alerts, f.devices),
    "alert_listing_unread": lambda f: listing.alert_listing(f.alerts, f.devices, unread_only=True),
    "filter_alerts": lambda f: listing.filter_alerts(listing.alert_listing(f.alerts, f.devices), "critical"),
    "device_alerts": device_alerts,
    "recent_alerts": lambda f: listing.recent_alerts(listing.alert_listing(f.alerts, f.devices)),
    "offline_devices": lambda f: listing.offline_devices(f.devices),
    "search_audit": lambda f: listing.search_audit(f.audit_logs, 200, "SER_1", "LOGIN_FAILED"),
    "filter_audit": lambda f: listing.filter_audit(listing.search_audit(f.audit_logs, 200), "VIEW_DEVICE", '"K": 4'),
    "filter_audit_all": lambda f: listing.filter_audit(f.audit_logs, "all", "er_7"),
    "recent_scans": lambda f: listing.recent_scans(f.scan_history),
    "last_checks": lambda f: listing.last_checks(f.uptime_log, f.devices),
    "user_directory": lambda f: listing.user_directory(f.users),
    "device_ports": lambda f: listing.device_ports(f.devices),
    "live_sessions": live_sessions,
    # rules and scans
    "os_family": lambda f: f.devices.select("id", "os_name", rules.os_family(F.col("os_name")).alias("os_family")),
    "device_type_basic": typed_by_name,
    "device_type_advanced": typed_by_ports,
    "typed_in_sql": typed_in_sql,
    "flatten_scan": lambda f: scans.flatten_scan(f.host_scan),
    "flatten_scan_quick": lambda f: scans.flatten_scan(f.host_scan, detailed=False),
    "scan_summary": lambda f: scans.scan_summary(f.host_scan),
    "open_scans": open_scans,
    "close_scans": lambda f: scans.close_scans(f.scan_history, f.scan_outcomes, AS_OF_ORDERS),
    # status changes and alerts
    "status_flips": lambda f: flips.status_flips(f.uptime_log),
    "alert_rows": lambda f: alert_ops.alert_rows(flips.status_flips(f.uptime_log), f.devices),
    "notification_rows": lambda f: alert_ops.notification_rows(f.alerts, f.devices),
    "new_device_alerts": lambda f: alert_ops.new_device_alerts(f.scan_results, f.devices, AS_OF_EVENTS),
    # table changes
    "upsert_devices": lambda f: changes.upsert_devices(f.devices, f.scan_results, AS_OF_EVENTS),
    "upsert_devices_keep_known": lambda f: changes.upsert_devices(
        f.devices, f.scan_results, AS_OF_EVENTS, keep_known=True
    ),
    "assign_ids": new_ids,
    "apply_status": lambda f: changes.apply_status(f.devices, f.uptime_log),
    "apply_edits": lambda f: changes.apply_edits(f.devices, f.device_edits),
    "mark_read": lambda f: changes.mark_read(f.alerts, f.alert_acks),
    "edit_audit_rows": edit_audit_rows,
    "scan_audit_rows": scan_audit_rows,
    "view_audit_rows": view_audit_rows,
    "export_audit_rows": export_audit_rows,
    "login_audit_rows": login_audit_rows,
    "logout_audit_rows": logout_audit_rows,
    "revoke_sessions": revoke_sessions,
    "apply_last_login": lambda f: sessions.apply_last_login(f.users, f.audit_logs),
    "delete_devices": delete_devices,
    # sources and sinks
    "load_table": load_table,
    "append_table": append_table,
    "audit_constraints": audit_constraints,
    "fill_defaults": fill_defaults,
    "inventory_export": lambda f: exports.inventory_export(f.devices),
    "inventory_report": lambda f: exports.inventory_report(f.devices),
    "json_rows": lambda f: exports.to_json_rows(f.audit_logs.select(listing.AUDIT_COLUMNS)),
    "table_counts": table_counts,
    "load_since": load_since,
    "load_csv": load_csv,
    "load_host_scan": load_host_scan,
    "host_scan_rejects": host_scan_rejects,
    "append_repeated": append_repeated,
    "export_csv": export_csv,
    # sums kept up by increments
    "ranking_of_days": ranking_of_days,
    # streams
    "stream_log": lambda f: stored(f, streamed_checks(f), "log"),
    "stream_flips": stream_flips,
    "stream_alerts": stream_alerts,
    "stream_status": stream_status,
    "stream_daily_uptime": lambda f: plain_times(streamed_days(f)),
    "stream_sliding_uptime": stream_sliding_uptime,
    "stream_days_in_time": lambda f: late_days(f)[0],
    "stream_late_checks": stream_late_checks,
    "sliding_uptime": lambda f: plain_times(probes.sliding_of_days(probes.daily_uptime(f.uptime_log))),
    "monitor_flips": lambda f: plain_times(monitor.monitored_flips(f.spark, monitored(f))),
    "monitor_alerts": lambda f: plain_times(monitor.monitored_alerts(f.spark, monitored(f))),
    "monitor_status": monitor_status,
    "stream_daily_alerts": lambda f: plain_times(streamed_alert_days(f)),
}


def queries() -> dict[str, Query]:
    def bound(build: Callable[[Fleet], DataFrame]) -> Query:
        return lambda spark, sf_dir: build(Fleet(spark, sf_dir))

    return {name: bound(build) for name, build in CATALOG.items()}
