"""Scan output to inventory rows, and the life of a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.clock import AsOf, moment, type_of
from fleetlens.functions.rules import device_type_advanced, device_type_basic, os_family
from fleetlens.operators.changes import assign_ids, last_per_id


def open_port_numbers(protocols: Column) -> Column:
    """Open ports of all protocols; protocols by name, ports by number (maps have no order)."""

    def of_protocol(name: Column) -> Column:
        ports = F.try_element_at(protocols, name)
        numbers = F.array_sort(F.map_keys(ports))
        return F.filter(numbers, lambda p: F.try_element_at(ports, p)["state"] == "open")

    found = F.flatten(F.transform(F.array_sort(F.map_keys(protocols)), of_protocol))
    return F.coalesce(found, F.array().cast(T.ArrayType(T.IntegerType())))


def flatten_scan(host_scan: DataFrame, detailed: bool = True) -> DataFrame:
    """Hosts that are up as flat scan rows: classified, online, with MAC, OS and open ports.

    A quick scan (``detailed=False``) knows neither OS nor ports and classifies by name and address.
    """
    up = host_scan.filter(F.col("state") == "up")
    nothing = F.lit(None).cast("string")
    mac = F.try_element_at("addresses", F.lit("mac"))
    if not detailed:
        return up.select(
            "scan_id",
            "seq",
            "ip_address",
            "hostname",
            device_type_basic(F.col("hostname"), F.col("ip_address")).alias("device_type"),
            nothing.alias("os_name"),
            nothing.alias("os_family"),
            mac.alias("mac_address"),
            F.lit("online").alias("status"),
            nothing.alias("open_ports"),
        )
    seen = up.withColumns(
        {"_ports": open_port_numbers(F.col("protocols")), "os_name": F.get("osmatch", F.lit(0))["name"]}
    )
    host, ip, ports, os = (F.col(c) for c in ("hostname", "ip_address", "_ports", "os_name"))
    port_text = F.array_join(F.transform(ports, lambda p: p.cast("string")), ",")
    return seen.select(
        "scan_id",
        "seq",
        "ip_address",
        "hostname",
        device_type_advanced(host, ip, ports, os).alias("device_type"),
        "os_name",
        os_family(os).alias("os_family"),
        mac.alias("mac_address"),
        F.lit("online").alias("status"),
        F.nullif(port_text, F.lit("")).alias("open_ports"),
    )


def scan_summary(host_scan: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """Hosts found up per scan. With ``scans`` (ids), scans that found or left nothing count 0."""
    found = host_scan.groupBy("scan_id").agg(F.count_if(F.col("state") == "up").alias("devices_found"))
    if scans is None:
        return found
    ids = scans.select(F.col("id").alias("scan_id"))
    zero = F.lit(0).cast("bigint")
    return ids.join(found, "scan_id", "left").withColumn("devices_found", F.coalesce("devices_found", zero))


def open_scans(requests: DataFrame, scans: DataFrame, as_of: AsOf = None) -> DataFrame:
    """Running scan rows for requested ranges (request_no, ip_range, triggered_by), keys assigned."""
    started = type_of(scans, "started_at")
    bucket = F.call_function("div", F.col("request_no"), F.lit(1_000_000))
    numbered = assign_ids(requests, scans, F.lit(0), bucket, [F.col("request_no")])
    return numbered.select(
        "id",
        F.trim("ip_range").alias("ip_range"),
        moment(as_of, started).alias("started_at"),
        F.lit(None).cast(type_of(scans, "finished_at")).alias("finished_at"),
        F.lit(0).alias("devices_found"),
        F.lit("running").alias("status"),
        F.coalesce("triggered_by", F.lit("manual")).alias("triggered_by"),
    )


def close_scans(scans: DataFrame, outcomes: DataFrame, as_of: AsOf = None, order: str | None = None) -> DataFrame:
    """Scan rows after their outcomes (id, devices_found, status): end time, count and status set.

    A failed scan counts 0. Of several outcomes of a scan the last by the column ``order`` counts.
    """
    failed = F.col("status") == "failed"
    outcomes = outcomes.select("id", "devices_found", "status", *([order] if order else []))
    done = last_per_id(outcomes, order).select(
        "id",
        F.when(failed, F.lit(0)).otherwise(F.col("devices_found")).alias("_found"),
        F.col("status").alias("_status"),
        F.lit(True).alias("_closed"),
    )
    closed = F.coalesce("_closed", F.lit(False))
    ended = moment(as_of, type_of(scans, "finished_at"))
    return scans.join(done, "id", "left").select(
        "id",
        "ip_range",
        "started_at",
        F.when(closed, ended).otherwise(F.col("finished_at")).alias("finished_at"),
        F.when(closed, F.col("_found")).otherwise(F.col("devices_found")).cast("int").alias("devices_found"),
        F.when(closed, F.col("_status")).otherwise(F.col("status")).alias("status"),
        "triggered_by",
    )
