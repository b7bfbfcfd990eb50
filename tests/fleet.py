"""A small office network for the tests: 13 devices, 3 scans, 4 alerts, 72 checks."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from fleetlens.sources.schemas import TABLES

NOW = datetime(2024, 5, 1, 12, 0, 0)

# last octet, hostname, type, OS, family, department, status, ports
OFFICE = [
    (1, "edge-gw", "Router", "Cisco IOS 15.2", "Cisco", "IT", "online", "80,443,22"),
    (10, "WIN-SRV-A", "Server", "Windows Server 2019", "Windows", "IT", "online", "80,443,3389,8080"),
    (11, "db-srv-a", "Server", "Ubuntu 22.04", "Linux", "IT", "online", "22,80,443,3306"),
    (12, "db-srv-b", "Server", "Ubuntu 20.04", "Linux", "IT", "offline", "22,8080"),
    (13, "WIN-SRV-B", "Server", "Windows Server 2022", "Windows", "IT", "online", "80,443,3389"),
    (20, "LAPTOP-1", "Laptop", "Windows 11", "Windows", "HR", "online", "3389"),
    (21, "LAPTOP-2", "Laptop", "Windows 10", "Windows", "HR", "online", "3389"),
    (22, "LAPTOP-3", "Laptop", "Windows 11", "Windows", "Finance", "offline", "3389"),
    (23, "macbook-1", "Laptop", "macOS 13", "Other", "Development", "online", "22,8080"),
    (24, "dev-box", "Laptop", "Ubuntu 22.04", "Linux", "Development", "online", "22,3000,8080"),
    (50, "printer-1", "Printer", None, "Other", "HR", "online", "9100,515"),
    (51, "printer-2", "Printer", None, "Other", "Finance", "offline", "9100"),
    (99, None, "Unknown", None, None, None, "unknown", None),
]


def frame(spark: SparkSession, table: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, TABLES[table])


def ago(**span) -> datetime:
    return NOW - timedelta(**span)


def devices(spark: SparkSession) -> DataFrame:
    rows = [
        (i, f"192.168.1.{octet}", host, kind, os, family, None, None, dept, status, ports, NOW, ago(days=i % 3), None)
        for i, (octet, host, kind, os, family, dept, status, ports) in enumerate(OFFICE, 1)
    ]
    return frame(spark, "devices", rows)


def scan_history(spark: SparkSession) -> DataFrame:
    rows = [
        (1, "192.168.1.1-255", ago(days=1), ago(days=1) + timedelta(minutes=3), 11, "completed", "manual"),
        (2, "192.168.1.1-255", ago(hours=12), ago(hours=12) + timedelta(seconds=59), 12, "completed", "scheduled"),
        (3, "192.168.1.1-255", ago(hours=1), None, 0, "running", "manual"),
    ]
    return frame(spark, "scan_history", rows)


def alerts(spark: SparkSession) -> DataFrame:
    rows = [
        (1, 4, "offline", "db-srv-b is down", "critical", False, ago(minutes=45)),
        (2, 8, "offline", "LAPTOP-3 is down", "warning", False, ago(hours=2)),
        (3, 12, "offline", "printer-2 is down", "warning", True, ago(hours=5)),
        (4, 13, "new_device", "unknown device", "info", False, ago(minutes=10)),
    ]
    return frame(spark, "alerts", rows)


def uptime_log(spark: SparkSession) -> DataFrame:
    """Three servers checked hourly; the third is down at the newest check only."""
    rows = []
    for hour in range(24):
        at = ago(hours=hour)
        rows.append((3 * hour + 1, 2, at, True, 5 + hour % 20))
        rows.append((3 * hour + 2, 3, at, True, 0))
        rows.append((3 * hour + 3, 4, at, hour > 0, 8 if hour else None))
    return frame(spark, "uptime_log", rows)


def tuples(df: DataFrame) -> list[tuple]:
    return [tuple(r) for r in df.collect()]
