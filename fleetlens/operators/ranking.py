"""Uptime per device and the uptime ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.labels import UNASSIGNED, UNKNOWN
from fleetlens.functions.numbers import percent, percent_tenths, rounded_ratio
from fleetlens.functions.rules import uptime_band
from fleetlens.operators.metrics import check_sums
from fleetlens.operators.ordering import with_positions
from fleetlens.session import settled

QUARTILES = 4
IDS_PER_BUCKET = 1_000_000


def device_uptime(devices: DataFrame, uptime: DataFrame) -> DataFrame:
    """Checks, online checks, percentage and mean response of every device.

    Checks are summed per device before the join, so one row per device meets the inventory. Devices
    without checks stay, with NULL percentage. Responses of 0 count towards the mean.
    """
    sums = check_sums(uptime, "device_id").withColumnRenamed("device_id", "id")
    zero = F.lit(0).cast("bigint")
    return (
        devices.select("id", "ip_address", "hostname", "device_type", "department")
        .join(sums, "id", "left")
        .select(
            "id",
            "ip_address",
            "hostname",
            "device_type",
            "department",
            F.coalesce("total_checks", zero).alias("total_checks"),
            F.coalesce("online_checks", zero).alias("online_checks"),
            percent(F.col("online_checks"), F.col("total_checks")).alias("uptime_pct"),
            F.try_divide(F.col("response_sum").cast("double"), F.col("response_n")).alias("avg_response_ms"),
        )
    )


def bucket_of(position: Column, total: Column, buckets: int) -> Column:
    """The bucket ``ntile(buckets)`` puts a position into: the first ``total % buckets`` get one more."""
    size = F.call_function("div", total, F.lit(buckets))
    longer = total % F.lit(buckets)
    in_longer = longer * (size + 1)
    short = F.call_function("div", position - 1 - in_longer, F.greatest(size, F.lit(1).cast("bigint")))
    return F.when(position <= in_longer, F.call_function("div", position - 1, size + 1) + 1).otherwise(
        longer + short + 1
    )


def uptime_ranking(devices: DataFrame, uptime: DataFrame) -> DataFrame:
    """Checked devices ranked by uptime over all time, with quartile and band; see ``ranking_of_sums``."""
    return ranking_of_sums(devices, check_sums(uptime, "device_id"))


def ranking_of_sums(devices: DataFrame, sums: DataFrame) -> DataFrame:
    """The ranking from sums of checks, one row per device, whatever they were added up from.

    Rank and quartile follow the percentage rounded to a tenth; ties share a rank, and break by device
    id for the quartile. At most 1,001 percentages exist, so the histogram of (percentage, id range)
    gives every device its place without one task seeing all devices, nor all devices at 100 %. The
    scored devices are settled, so checks and devices are scanned once.
    """
    checked = sums.withColumnRenamed("device_id", "id")
    named = devices.select("id", "ip_address", "hostname", "device_type", "department").join(checked, "id")
    scored = named.withColumn("tenths", percent_tenths(F.col("online_checks"), F.col("total_checks")))
    id_range = F.call_function("div", F.col("id"), F.lit(IDS_PER_BUCKET))
    placed = with_positions(settled(scored), -F.col("tenths"), id_range, [F.col("id")])
    uptime_pct = F.col("tenths") / F.lit(10.0)
    return placed.select(
        "ip_address",
        F.coalesce("hostname", F.lit(UNKNOWN)).alias("hostname"),
        "device_type",
        F.coalesce("department", F.lit(UNASSIGNED)).alias("department"),
        "total_checks",
        F.coalesce(uptime_pct, F.lit(0.0)).alias("uptime_pct"),
        rounded_ratio(F.col("response_sum"), F.col("response_n")).cast("double").alias("avg_ms"),
        (F.col("before") + 1).alias("rank_uptime"),
        bucket_of(F.col("position"), F.col("total"), QUARTILES).alias("quartile"),
        uptime_band(uptime_pct).alias("band"),
    ).orderBy("rank_uptime", "ip_address")
