"""Uptime kept as sums per device and day, so that figures over all time read days and not every check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.metrics import check_sums
from fleetlens.operators.ranking import ranking_of_sums

SUMS = ["total_checks", "online_checks", "response_sum", "response_n"]
DAYS = f"day date, device_id bigint, {', '.join(f'{c} bigint' for c in SUMS)}, increment string"


def day_sums(checks: DataFrame) -> DataFrame:
    """Sums of checks per day and device. Sums of several increments can be added up in any order."""
    return check_sums(checks.withColumn("day", F.to_date("checked_at")), "day", "device_id")


def add_increment(checks: DataFrame, path: str, increment: str) -> None:
    """Store the sums of newly arrived checks under the name of their increment.

    Only the new checks are read. A repeated increment replaces itself. Checks of days long past are one more row
    of their day, so nothing stored is read or rewritten.
    """
    rows = day_sums(checks).withColumn("increment", F.lit(increment))
    writer = rows.write.partitionBy("increment").mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def stored_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DAYS).parquet(path)


def merged(days: DataFrame, *keys: str) -> DataFrame:
    """Stored sums added up per key: ``device_id`` for figures over all time, with ``day`` to merge increments."""
    return days.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in SUMS))


def merge_increments(spark: SparkSession, path: str, target: str, increment: str = "merged") -> None:
    """Write all increments as one to a fresh path, one row per day and device, so that reading stays cheap."""
    rows = merged(stored_days(spark, path), "day", "device_id").withColumn("increment", F.lit(increment))
    rows.write.partitionBy("increment").mode("overwrite").parquet(target)


def ranking_of_days(devices: DataFrame, days: DataFrame) -> DataFrame:
    """``uptime_ranking`` from stored sums."""
    return ranking_of_sums(devices, merged(days, "device_id"))
