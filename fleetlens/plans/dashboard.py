"""The dashboard figures as one frame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.metrics import rows, unread_alert_count


def dashboard_stats(devices: DataFrame, alerts: DataFrame) -> DataFrame:
    """Totals, devices by type and by OS, and unread alerts as (section, name, n).

    The devices are read once into counts per (status, type, OS family); every figure is a sum over
    that small frame. The NULL type is dropped after the sum: dropped before, the filter would reach the
    scan and the parts could no longer share their shuffle.
    """
    cells = devices.groupBy("status", "device_type", "os_family").agg(rows().alias("n"))

    def total(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("bigint")

    names = ["total", "online", "offline", "unknown"]
    tests = [F.lit(True)] + [F.col("status") == s for s in names[1:]]
    totals = cells.agg(*[total(t).alias(n) for n, t in zip(names, tests)])
    entries = [F.struct(F.lit("total").alias("section"), F.lit(n).alias("name"), F.col(n).alias("n")) for n in names]
    parts = [totals.select(F.inline(F.array(*entries)))]
    for section, column in (("by_type", "device_type"), ("by_os", "os_family")):
        counted = F.sum(F.when(F.col(column).isNotNull(), F.col("n"))).alias("n")
        grouped = cells.groupBy(F.col(column).alias("name")).agg(counted).filter("n IS NOT NULL")
        parts.append(grouped.select(F.lit(section).alias("section"), "name", "n"))
    unread = unread_alert_count(alerts).select(
        F.lit("alerts").alias("section"), F.lit("unread").alias("name"), F.col("unread_alerts").alias("n")
    )
    return reduce(DataFrame.unionByName, [*parts, unread])
