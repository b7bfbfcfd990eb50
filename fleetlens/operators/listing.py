"""Listings, searches and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.labels import ACTION_LABELS, ALERT_TYPE_LABELS, SCAN_STATUS_LABELS, UNKNOWN, labelled
from fleetlens.functions.rules import chart_value
from fleetlens.functions.text import address_from_url, contains_text, duration_text, or_else
from fleetlens.operators.ordering import first_rows_per_key

DEVICE_COLUMNS = [
    "id",
    "ip_address",
    "hostname",
    "device_type",
    "os_name",
    "os_family",
    "mac_address",
    "owner",
    "department",
    "status",
    "open_ports",
    "last_seen",
    "first_seen",
    "notes",
]


def status_rank() -> Column:
    return F.when(F.col("status") == "online", 1).when(F.col("status") == "offline", 2).otherwise(3)


def in_listing_order(devices: DataFrame) -> DataFrame:
    """Online first, then offline, then the rest; addresses compare as text."""
    return devices.orderBy(status_rank(), "ip_address")


def device_listing(devices: DataFrame) -> DataFrame:
    return in_listing_order(devices.select(*DEVICE_COLUMNS, status_rank().alias("status_rank")))


def _wanted_addresses(keys: DataFrame, column: str) -> DataFrame:
    return keys.select(address_from_url(F.col(column)).alias("ip_address")).distinct()


def lookup_devices(devices: DataFrame, keys: DataFrame, column: str = "ip_address") -> DataFrame:
    """Devices by address; addresses may come in their link form with ``-`` for ``.``."""
    return devices.select(*DEVICE_COLUMNS).join(_wanted_addresses(keys, column), "ip_address", "left_semi")


def missing_devices(devices: DataFrame, keys: DataFrame, column: str = "ip_address") -> DataFrame:
    """Looked-up addresses that no device has."""
    return _wanted_addresses(keys, column).join(devices.select("ip_address"), "ip_address", "left_anti")


def search_inventory(devices: DataFrame, facet: str = "all", text: str = "") -> DataFrame:
    """One facet (status or device type) and a substring over address, hostname, owner, department."""
    in_facet = F.lit(True) if facet == "all" else (F.col("status") == facet) | (F.col("device_type") == facet)
    found = contains_text(["ip_address", "hostname", "owner", "department"], text)
    return devices.select(*DEVICE_COLUMNS).filter(in_facet & found)


def alert_listing(alerts: DataFrame, devices: DataFrame, unread_only: bool = False) -> DataFrame:
    """Alerts with the address and name of their device, newest first. Orphan alerts drop out."""
    rows = alerts.filter(~F.col("is_read")) if unread_only else alerts
    names = devices.select(F.col("id").alias("device_id"), "ip_address", "hostname")
    return (
        rows.join(names, "device_id")
        .select(
            "id",
            "alert_type",
            labelled(F.col("alert_type"), ALERT_TYPE_LABELS).alias("type_label"),
            "message",
            "severity",
            "is_read",
            "created_at",
            "ip_address",
            "hostname",
        )
        .orderBy(F.desc("created_at"), F.desc("id"))
    )


def filter_alerts(listing: DataFrame, facet: str = "all") -> DataFrame:
    """all, unread, or one of the severities."""
    if facet == "all":
        return listing
    return listing.filter(~F.col("is_read") if facet == "unread" else F.col("severity") == facet)


def device_alerts(alerts: DataFrame, devices: DataFrame, addresses: DataFrame) -> DataFrame:
    """Alerts of the devices at the given addresses."""
    chosen = devices.join(addresses.select("ip_address").distinct(), "ip_address", "left_semi")
    return alert_listing(alerts, chosen)


def recent_alerts(listing: DataFrame, n: int = 5) -> DataFrame:
    return listing.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def offline_devices(devices: DataFrame) -> DataFrame:
    """Offline devices with a label in place of a missing name."""
    return devices.filter(F.col("status") == "offline").select(
        "ip_address",
        or_else(F.col("hostname"), F.lit(UNKNOWN)).alias("hostname"),
        or_else(F.col("device_type"), F.lit("?")).alias("device_type"),
        "last_seen",
    )


AUDIT_COLUMNS = [
    "id",
    "username",
    "action",
    "entity_type",
    "entity_id",
    "details",
    "ip_address",
    "status",
    "created_at",
]


def search_audit(audit: DataFrame, n: int = 100, username: str | None = None, action: str | None = None) -> DataFrame:
    """Newest ``n`` audit rows after filtering by part of the user name and by action."""
    rows = audit.select(*AUDIT_COLUMNS)
    if username:
        rows = rows.filter(F.contains(F.lower("username"), F.lit(username.lower())))
    if action:
        rows = rows.filter(F.col("action") == action)
    newest = rows.orderBy(F.desc("created_at"), F.desc("id")).limit(n)
    return newest.withColumn("action_label", labelled(F.col("action"), ACTION_LABELS))


def filter_audit(rows: DataFrame, action: str = "all", text: str = "") -> DataFrame:
    """Action facet and substring over user name or details, on rows already fetched."""
    in_facet = F.lit(True) if action == "all" else F.col("action") == action
    return rows.filter(in_facet & contains_text(["username", "details"], text))


def recent_scans(scans: DataFrame, n: int = 20) -> DataFrame:
    """The newest scans with their status label and duration text."""
    newest = scans.orderBy(F.desc("started_at"), F.desc("id")).limit(n)
    return newest.select(
        "id",
        "ip_range",
        "started_at",
        "finished_at",
        "devices_found",
        "status",
        "triggered_by",
        labelled(F.col("status"), SCAN_STATUS_LABELS).alias("status_label"),
        duration_text(F.col("started_at"), F.col("finished_at")).alias("duration"),
    )


def last_checks(uptime: DataFrame, devices: DataFrame, n: int = 24, ips: list[str] | None = None) -> DataFrame:
    """The newest ``n`` checks of every device (or of the given addresses), newest first.

    ``check_no`` counts from 1 at the newest check. ``time_of_day`` and ``chart_value`` are what the
    device page plots. Checks are pruned to ``n`` per device before the join with the names.
    """
    names = devices.select(F.col("id").alias("device_id"), "ip_address")
    if ips is not None:
        names = names.filter(F.col("ip_address").isin(ips))
        uptime = uptime.join(names.select("device_id"), "device_id", "left_semi")
    newest = first_rows_per_key(uptime, ["device_id"], [F.desc("checked_at"), F.desc("id")], n, "check_no")
    return newest.join(names, "device_id").select(
        "device_id",
        "ip_address",
        F.col("check_no").cast("bigint").alias("check_no"),
        "checked_at",
        F.date_format("checked_at", "HH:mm").alias("time_of_day"),
        "is_online",
        "response_ms",
        chart_value(F.col("is_online"), F.col("response_ms")).alias("chart_value"),
    )


def user_directory(users: DataFrame, names: list[str] | None = None, ids: list[int] | None = None) -> DataFrame:
    """Users without any secret, newest first; optionally only the given names or ids."""
    rows = users.select("id", "username", "email", "role", "is_active", "last_login", "created_at")
    if names is not None:
        rows = rows.filter(F.col("username").isin(names))
    if ids is not None:
        rows = rows.filter(F.col("id").isin(ids))
    return rows.orderBy(F.desc("created_at"), F.desc("id"))


def device_ports(devices: DataFrame) -> DataFrame:
    """One row per listed port, trimmed; devices without ports give none."""
    return devices.select("id", "ip_address", F.explode(F.split("open_ports", ",")).alias("port")).select(
        "id", "ip_address", F.trim("port").alias("port")
    )
