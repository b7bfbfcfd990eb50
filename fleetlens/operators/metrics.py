"""Counts, shares and period indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.clock import AsOf, days_before, type_of
from fleetlens.functions.labels import ALERT_TYPE_LABELS, ANONYMOUS, UNASSIGNED, labelled
from fleetlens.functions.numbers import percent, percent_tenths, rounded_ratio
from fleetlens.operators.listing import last_checks, search_audit
from fleetlens.operators.ordering import rank_by_histogram
from fleetlens.session import settled

EARLIER_AND_SELF = (Window.unboundedPreceding, Window.currentRow)


def rows() -> Column:
    return F.count(F.lit(1))


def status_counts(devices: DataFrame) -> DataFrame:
    """One row: all devices and those online, offline, unknown. Zero on an empty table."""
    known = [F.count_if(F.col("status") == s).alias(s) for s in ("online", "offline", "unknown")]
    return devices.agg(rows().alias("total"), *known)


def _devices_by(devices: DataFrame, column: str) -> DataFrame:
    per_value = devices.filter(F.col(column).isNotNull()).groupBy(column).agg(rows().alias("n_devices"))
    return per_value.orderBy(F.desc("n_devices"), column)


def devices_by_type(devices: DataFrame) -> DataFrame:
    return _devices_by(devices, "device_type")


def devices_by_os(devices: DataFrame) -> DataFrame:
    return _devices_by(devices, "os_family")


def unread_alert_count(alerts: DataFrame) -> DataFrame:
    """Unread alerts, orphans included."""
    return alerts.filter(~F.col("is_read")).agg(rows().alias("unread_alerts"))


def check_sums(uptime: DataFrame, *keys: str) -> DataFrame:
    """Partial sums of checks per key; everything an uptime figure needs."""
    return uptime.groupBy(*keys).agg(
        rows().alias("total_checks"),
        F.count_if("is_online").alias("online_checks"),
        F.sum(F.col("response_ms").cast("bigint")).alias("response_sum"),
        F.count("response_ms").alias("response_n"),
    )


def period_kpi(
    uptime: DataFrame, devices: DataFrame, alerts: DataFrame, scans: DataFrame, as_of: AsOf = None, days: int = 30
) -> DataFrame:
    """One row of indicators for the last ``days`` days.

    ``avg_uptime`` is the plain mean over devices with a check in the period of their percentage
    rounded to a tenth, itself rounded to a tenth; 0 without checks. The device total knows no period.
    Each figure is a scalar subquery.
    """

    def since(df: DataFrame, column: str) -> DataFrame:
        return df.filter(F.col(column) >= days_before(as_of, days, type_of(df, column)))

    per_device = check_sums(since(uptime, "checked_at"), "device_id").select(
        percent_tenths(F.col("online_checks"), F.col("total_checks")).alias("tenths")
    )
    mean = per_device.agg((rounded_ratio(F.sum("tenths"), rows()) / F.lit(10.0)).alias("v"))
    return devices.sparkSession.range(1).select(
        F.coalesce(mean.scalar(), F.lit(0.0)).alias("avg_uptime"),
        devices.agg(rows().alias("v")).scalar().alias("total_devices"),
        since(alerts, "created_at").agg(rows().alias("v")).scalar().alias("total_alerts"),
        since(scans, "started_at").agg(rows().alias("v")).scalar().alias("total_scans"),
    )


def daily_activity(scans: DataFrame, alerts: DataFrame, as_of: AsOf = None, days: int = 30) -> DataFrame:
    """Scans and alerts per calendar day of the period; days without either are absent.

    ``prev_day_alerts`` is the count of the previous present day. The window runs over one row per day.
    """

    def per_day(df: DataFrame, column: str, kind: str) -> DataFrame:
        recent = df.filter(F.col(column) >= days_before(as_of, days, type_of(df, column)))
        daily = recent.groupBy(F.to_date(column).alias("day")).agg(rows().alias("n"))
        return daily.select("day", F.lit(kind).alias("kind"), "n")

    both = per_day(scans, "started_at", "scan").unionByName(per_day(alerts, "created_at", "alert"))
    daily = both.groupBy("day").agg(
        F.sum(F.when(F.col("kind") == "scan", F.col("n")).otherwise(0)).alias("scans"),
        F.sum(F.when(F.col("kind") == "alert", F.col("n")).otherwise(0)).alias("alerts"),
    )
    previous = F.lag("alerts").over(Window.orderBy("day"))
    return daily.withColumn("prev_day_alerts", previous).orderBy(F.desc("day"))


def department_share(devices: DataFrame) -> DataFrame:
    """Devices per department with their share of all devices.

    Grouped on the stored value and labelled afterwards: NULL and '' stay two groups, and a department
    that is spelled like the label stays apart from NULL.
    """
    per_department = devices.groupBy("department").agg(
        rows().alias("total_devices"),
        F.count_if(F.col("status") == "online").alias("online"),
        F.count_if(F.col("status") == "offline").alias("offline"),
    )
    all_devices = devices.agg(rows().alias("v")).scalar()
    return per_department.select(
        F.coalesce("department", F.lit(UNASSIGNED)).alias("department"),
        "total_devices",
        "online",
        "offline",
        percent(F.col("total_devices"), all_devices).alias("share_pct"),
    ).orderBy(F.desc("total_devices"), "department")


def alert_analysis(alerts: DataFrame) -> DataFrame:
    """Alerts per type by severity, unread, first and last; most frequent type first."""
    per_type = alerts.groupBy("alert_type").agg(
        rows().alias("total"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.count_if(F.col("severity") == "info").alias("infos"),
        F.count_if(~F.col("is_read")).alias("unread"),
        F.min("created_at").alias("first_alert"),
        F.max("created_at").alias("last_alert"),
    )
    label = labelled(F.col("alert_type"), ALERT_TYPE_LABELS)
    return per_type.withColumn("type_label", label).orderBy(F.desc("total"), "alert_type")


def device_growth(devices: DataFrame) -> DataFrame:
    """New devices per day, running total, and growth against the previous day's total.

    The windows run over one row per day.
    """
    daily = (
        devices.filter(F.col("first_seen").isNotNull())
        .groupBy(F.to_date("first_seen").alias("discovered_on"))
        .agg(rows().alias("new_devices"))
    )
    by_day = Window.orderBy("discovered_on")
    running = daily.withColumn("cumulative_total", F.sum("new_devices").over(by_day.rowsBetween(*EARLIER_AND_SELF)))
    growth = percent(F.col("new_devices"), F.lag("cumulative_total").over(by_day))
    return running.withColumn("growth_pct", growth).orderBy(F.desc("discovered_on"))


def user_activity(audit: DataFrame) -> DataFrame:
    """Actions per user and kind with failures, first and last time, and the user's rank in the kind.

    Rows without a user name form one group, labelled afterwards. The counts per user are read twice and
    therefore settled first.
    """
    per_user = audit.groupBy("username", "action").agg(
        rows().alias("n_actions"),
        F.count_if(F.col("status") == "failed").alias("n_failed"),
        F.min("created_at").alias("first_action"),
        F.max("created_at").alias("last_action"),
    )
    ranked = rank_by_histogram(settled(per_user), "n_actions", ["action"], "rank_in_action")
    name = F.coalesce("username", F.lit(ANONYMOUS))
    return ranked.select(
        name.alias("username"),
        "action",
        "n_actions",
        "n_failed",
        "first_action",
        "last_action",
        "rank_in_action",
    ).orderBy("username", F.desc("n_actions"))


def audit_headline(audit: DataFrame, n: int = 200) -> DataFrame:
    """Header numbers over the newest ``n`` audit rows."""
    fetched = search_audit(audit, n)
    return fetched.agg(
        rows().alias("total"),
        F.count_if(F.col("action") == "LOGIN").alias("logins"),
        F.count_if(F.col("action") == "LOGIN_FAILED").alias("failed_logins"),
        F.count_if(F.col("action") == "SCAN_START").alias("scans"),
    )


def recent_uptime_summary(uptime: DataFrame, devices: DataFrame, n: int = 24) -> DataFrame:
    """Device page numbers over the newest ``n`` checks of every device.

    ``uptime_pct`` is a whole percentage, 0 without checks. ``avg_ms`` leaves out responses that are
    NULL or 0, unlike the mean of ``device_uptime``.
    """
    answered = F.nullif(F.col("response_ms"), F.lit(0)).cast("bigint")
    per_device = (
        last_checks(uptime, devices, n)
        .groupBy("device_id")
        .agg(
            rows().alias("checks"),
            F.count_if("is_online").alias("online"),
            F.sum(answered).alias("ms_sum"),
            F.count(answered).alias("ms_n"),
        )
    )
    zero = F.lit(0).cast("bigint")
    return devices.select(F.col("id").alias("device_id"), "ip_address").join(per_device, "device_id", "left").select(
        "device_id",
        "ip_address",
        F.coalesce("checks", zero).alias("checks"),
        F.coalesce(rounded_ratio(F.col("online"), F.col("checks"), 100), zero).alias("uptime_pct"),
        rounded_ratio(F.col("ms_sum"), F.col("ms_n")).alias("avg_ms"),
    )


def check_round_summary(uptime: DataFrame, interval: str = "300 seconds") -> DataFrame:
    """Online and offline checks per check round."""
    return (
        uptime.groupBy(F.window("checked_at", interval).alias("w"))
        .agg(F.count_if("is_online").alias("online"), F.count_if(~F.col("is_online")).alias("offline"))
        .select(F.col("w.start").alias("round_start"), F.col("w.end").alias("round_end"), "online", "offline")
    )
