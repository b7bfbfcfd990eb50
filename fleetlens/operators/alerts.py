"""Alert and notification rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.clock import AsOf, moment, type_of
from fleetlens.functions.text import or_else
from fleetlens.operators.changes import last_result_per_address, unseen_devices


def _named(hostname: str = "hostname") -> Column:
    return or_else(F.col(hostname), F.col("ip_address"))


def alert_rows(flips: DataFrame, devices: DataFrame) -> DataFrame:
    """One alert per status change (device_id, checked_at, alert_type).

    A server going offline is critical, any other device a warning, a return is an info. Works on a
    batch and on a stream of changes.
    """
    known = devices.select(F.col("id").alias("device_id"), "ip_address", "hostname", "device_type")
    kind = F.coalesce("device_type", F.lit("Device"))
    offline, server = F.col("alert_type") == "offline", F.col("device_type") == "Server"
    message = (
        F.when(offline & server, F.format_string("CRITICAL: Server %s (%s) is not responding!", _named(), "ip_address"))
        .when(offline, F.format_string("%s %s (%s) is offline.", kind, _named(), "ip_address"))
        .otherwise(F.format_string("%s %s (%s) is back online.", kind, _named(), "ip_address"))
    )
    severity = F.when(offline & server, "critical").when(offline, "warning").otherwise("info")
    return flips.join(known, "device_id").select(
        "device_id",
        "alert_type",
        message.alias("message"),
        severity.alias("severity"),
        F.lit(False).alias("is_read"),
        F.col("checked_at").alias("created_at"),
    )


def notification_rows(alerts: DataFrame, devices: DataFrame) -> DataFrame:
    """What a notification says, one row per offline or back-online alert. Nothing is sent."""
    sent = alerts.filter(F.col("alert_type").isin("offline", "back_online")).select(
        F.col("id").alias("alert_id"), "device_id", "alert_type", F.col("created_at").alias("detected_at")
    )
    known = devices.select(
        F.col("id").alias("device_id"), "ip_address", "hostname", "device_type", "os_name", "department", "owner"
    )
    offline = F.col("alert_type") == "offline"
    return sent.join(known, "device_id").select(
        "alert_id",
        F.when(offline, F.format_string("ALERT: %s is OFFLINE", _named()))
        .otherwise(F.format_string("%s is back ONLINE", _named()))
        .alias("subject"),
        F.when(offline, "OFFLINE").otherwise("ONLINE").alias("status_text"),
        F.when(offline, "The device does not answer and was marked offline.")
        .otherwise("The device answers again.")
        .alias("sentence"),
        _named().alias("device_name"),
        "ip_address",
        "device_type",
        "os_name",
        "department",
        "owner",
        "detected_at",
    )


def new_device_alerts(results: DataFrame, devices: DataFrame, as_of: AsOf = None) -> DataFrame:
    """An info alert for every scanned address that the inventory lacks.

    Device ids are those the upsert of the same results assigns.
    """
    return unseen_devices(devices, last_result_per_address(results)).select(
        F.col("id").alias("device_id"),
        F.lit("new_device").alias("alert_type"),
        F.format_string("Unknown device found on the network: %s. Please check!", "ip_address").alias("message"),
        F.lit("info").alias("severity"),
        F.lit(False).alias("is_read"),
        moment(as_of, type_of(devices, "first_seen")).alias("created_at"),
    )
