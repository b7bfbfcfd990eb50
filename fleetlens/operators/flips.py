"""Status changes over the history of checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.clock import type_of


def status_flips(uptime: DataFrame, previous: DataFrame | None = None, chunk: str = "hour") -> DataFrame:
    """Checks at which a device changed state, as (device_id, id, checked_at, alert_type).

    The first check of a device is silent, unless ``previous`` (device_id, is_online) tells its state
    from before; that state goes in as a check without a time, which sorts first.

    The history of every device is cut into time chunks, whatever its length. Inside a chunk the state before
    is a ``lag``. The first check of a chunk follows the last one of the chunk before, and is compared with it
    among the first and last checks of all chunks: two rows for each at most.
    """
    checks = uptime.select("device_id", "id", "checked_at", "is_online")
    if previous is not None:
        unknown = {c: F.lit(None).cast(type_of(checks, c)) for c in ("id", "checked_at")}
        checks = checks.unionByName(previous.select("device_id", "is_online").withColumns(unknown))
    inside = Window.partitionBy("device_id", "_chunk").orderBy("checked_at", "id")
    parts = checks.withColumn("_chunk", F.date_trunc(chunk, "checked_at")).withColumns(
        {
            "_before": F.lag("is_online").over(inside),
            "_first": F.lag(F.lit(True)).over(inside).isNull(),
            "_last": F.lead(F.lit(True)).over(inside).isNull(),
        }
    )
    columns = ["device_id", "id", "checked_at", "is_online", "_before", "_first"]
    ends = parts.filter("_first or _last").withColumn("_state", F.col("is_online"))
    across = Window.partitionBy("device_id").orderBy("checked_at", "id")
    firsts = ends.withColumn("_before", F.lag("_state").over(across)).filter("_first")
    compared = parts.filter("not _first").select(columns).unionByName(firsts.select(columns))
    return compared.filter("_before <> is_online").select(
        "device_id",
        "id",
        "checked_at",
        F.when(F.col("is_online"), "back_online").otherwise("offline").alias("alert_type"),
    )
