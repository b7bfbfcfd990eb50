"""Set-based changes of the inventory and its tables. Each returns a new DataFrame.

Write the result to a fresh path and swap; plain parquet has no in-place update.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.clock import AsOf, moment, type_of
from fleetlens.functions.labels import UNKNOWN
from fleetlens.operators.ordering import first_rows_per_key, positions_by_range, time_and_id, with_positions
from fleetlens.session import settled

ID_BUCKETS = 1024
SCANNED = ["hostname", "device_type", "os_name", "os_family", "mac_address", "status", "open_ports"]


def _last_id(existing: DataFrame) -> Column:
    return F.coalesce(existing.agg(F.max("id").alias("v")).scalar(), F.lit(0)).cast("bigint")


def assign_ids(new: DataFrame, existing: DataFrame, coarse: Column, fine: Column, order: list[Column]) -> DataFrame:
    """``new`` with an ``id`` following the largest existing one, in the order given.

    The running number comes from bucket counts (see ``with_positions``), so it is the same whenever
    the job or a task is repeated.
    """
    columns = new.columns
    placed = with_positions(new, coarse, fine, order)
    return placed.select((_last_id(existing) + F.col("position")).cast("bigint").alias("id"), *columns)


def assign_device_ids(new: DataFrame, devices: DataFrame) -> DataFrame:
    """Ids for rows with distinct addresses, in address order.

    Address text has at most 15 characters, so its first three characters take few values and its
    first six hold at most 11 x 65,536 addresses: both buckets are bounded.
    """
    address = F.col("ip_address")
    return assign_ids(new, devices, F.substring(address, 1, 3), F.substring(address, 1, 6), [address])


def with_new_ids(new: DataFrame, existing: DataFrame, time: str | None = None) -> DataFrame:
    """Ids for rows of any table, such as alerts or audit rows; equal content always gets the same numbers.

    With a ``time`` column ids follow it, then the other columns; rows are numbered within ranges of that order, so
    an outage that raises all alerts in one moment is split too. Without one they follow no particular order, and
    rows are numbered within buckets of their hash.
    """
    content = [F.col(c) for c in new.columns if c != time]
    if time:
        placed = positions_by_range(settled(new), [F.col(time), *content])
        return placed.select((_last_id(existing) + F.col("position")).cast("bigint").alias("id"), *new.columns)
    coarse = F.pmod(F.xxhash64(*content), F.lit(ID_BUCKETS))
    fine = F.pmod(F.xxhash64(F.lit("fine"), *content), F.lit(ID_BUCKETS))
    return assign_ids(new, existing, coarse, fine, content)


def last_result_per_address(results: DataFrame) -> DataFrame:
    """The last result of each address, by scan and place in the scan; missing type and status filled."""
    latest = first_rows_per_key(results, ["ip_address"], [F.desc("scan_id"), F.desc("seq")])
    return latest.select(
        "ip_address",
        "hostname",
        F.coalesce("device_type", F.lit(UNKNOWN)).alias("device_type"),
        "os_name",
        "os_family",
        "mac_address",
        F.coalesce("status", F.lit("online")).alias("status"),
        "open_ports",
    )


def unseen_devices(devices: DataFrame, found: DataFrame) -> DataFrame:
    """Found rows (one per address) whose address the inventory lacks, with the ids they get."""
    fresh = found.join(devices.select("ip_address"), "ip_address", "left_anti")
    return assign_device_ids(settled(fresh), devices)


def upsert_devices(devices: DataFrame, results: DataFrame, as_of: AsOf = None, keep_known: bool = False) -> DataFrame:
    """Inventory after a batch of scan results.

    A scanned device takes over every scanned field, NULLs included, so a quick scan forgets OS and
    ports; ``keep_known=True`` keeps known values instead. Id, owner, department, notes and first_seen
    stay. Unseen addresses are inserted with new ids.
    """
    now = moment(as_of, type_of(devices, "last_seen"))
    latest = settled(last_result_per_address(results))
    found = latest.select("ip_address", *[F.col(c).alias(f"_{c}") for c in SCANNED], F.lit(True).alias("_seen"))
    seen = F.coalesce("_seen", F.lit(False))

    def scanned(column: str) -> Column:
        new = F.coalesce(f"_{column}", column) if keep_known else F.col(f"_{column}")
        return F.when(seen, new).otherwise(F.col(column)).alias(column)

    columns = devices.columns
    updated = devices.join(found, "ip_address", "left").select(
        [
            scanned(c)
            if c in SCANNED
            else F.when(seen, now).otherwise(F.col(c)).alias(c)
            if c == "last_seen"
            else F.col(c)
            for c in columns
        ]
    )
    blank = {c: F.lit(None).cast(type_of(devices, c)) for c in ("owner", "department", "notes")}
    inserted = unseen_devices(devices, latest).withColumns(
        {**blank, "last_seen": now, "first_seen": moment(as_of, type_of(devices, "first_seen"))}
    )
    return updated.unionByName(inserted.select(columns))


def newest_status(uptime: DataFrame) -> DataFrame:
    """Per device the state of its newest check and the time of its newest online check."""
    return uptime.groupBy("device_id").agg(
        F.max_by("is_online", time_and_id()).alias("is_online"),
        F.max(F.when(F.col("is_online"), F.col("checked_at"))).alias("online_at"),
    )


def apply_newest_status(devices: DataFrame, newest: DataFrame) -> DataFrame:
    """Devices with status and last_seen taken from (device_id, is_online, online_at)."""
    state = newest.select(F.col("device_id").alias("id"), "is_online", "online_at")
    status = (
        F.when(F.col("is_online"), F.lit("online")).when(~F.col("is_online"), F.lit("offline")).otherwise(F.col("status"))
    )
    last_seen = F.greatest("last_seen", F.col("online_at").cast(type_of(devices, "last_seen")))
    joined = devices.join(state, "id", "left")
    return joined.withColumns({"status": status, "last_seen": last_seen}).select(devices.columns)


def apply_status(devices: DataFrame, uptime: DataFrame) -> DataFrame:
    """Devices after their newest checks. ``last_seen`` moves on to the newest online check, and never back."""
    return apply_newest_status(devices, newest_status(uptime))


def last_per_id(rows: DataFrame, order: str | None) -> DataFrame:
    """The row of each ``id`` that is last by ``order``; ties, and all rows without an order, go to the greatest row."""
    rest = [c for c in rows.columns if c != "id"]
    first = [order] if order else []
    last = F.max(F.struct(*first, *(c for c in rest if c not in first))).alias("_last")
    return rows.groupBy("id").agg(last).select("id", *(F.col(f"_last.{c}").alias(c) for c in rest))


def apply_edits(devices: DataFrame, edits: DataFrame, order: str | None = None) -> DataFrame:
    """Devices after edits of owner, department and notes; all three are replaced, NULLs included.

    Of several edits of a device the last by the column ``order`` counts.
    """
    fields = ["owner", "department", "notes"]
    edits = last_per_id(edits.select("id", *fields, *([order] if order else [])), order)
    new = edits.select("id", *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_edited"))
    edited = F.coalesce("_edited", F.lit(False))
    joined = devices.join(new, "id", "left")
    changed = {c: F.when(edited, F.col(f"_{c}")).otherwise(F.col(c)) for c in fields}
    return joined.withColumns(changed).select(devices.columns)


def mark_read(alerts: DataFrame, acks: DataFrame | None = None) -> DataFrame:
    """Alerts after acknowledging the listed ``alert_id``s, or all of them."""
    if acks is None:
        return alerts.withColumn("is_read", F.lit(True))
    read = acks.select(F.col("alert_id").alias("id")).distinct().withColumn("_read", F.lit(True))
    joined = alerts.join(read, "id", "left")
    return joined.withColumn("is_read", F.col("is_read") | F.col("_read").isNotNull()).select(alerts.columns)


def delete_devices(
    devices: DataFrame, alerts: DataFrame, uptime: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Devices, alerts and checks that remain after deleting devices by ``id`` with all their rows."""
    gone = ids.select("id").distinct()
    by_device = gone.withColumnRenamed("id", "device_id")
    return (
        devices.join(gone, "id", "left_anti"),
        alerts.join(by_device, "device_id", "left_anti"),
        uptime.join(by_device, "device_id", "left_anti"),
    )
