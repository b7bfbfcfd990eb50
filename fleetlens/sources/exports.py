"""Exports of inventory and result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.functions.text import print_timestamps
from fleetlens.operators.listing import in_listing_order
from fleetlens.session import settled

# Export columns with their report headings, row colours by status.
EXPORT_COLUMNS = [
    ("id", "ID"),
    ("ip_address", "IP Address"),
    ("hostname", "Hostname"),
    ("device_type", "Device Type"),
    ("os_name", "Operating System"),
    ("os_family", "OS Family"),
    ("mac_address", "MAC Address"),
    ("owner", "Owner"),
    ("department", "Department"),
    ("status", "Status"),
    ("open_ports", "Open Ports"),
    ("first_seen", "First Seen"),
    ("last_seen", "Last Seen"),
    ("notes", "Notes"),
]
EXPORT_SCHEMA = ", ".join(f"{c} {'bigint' if c == 'id' else 'string'}" for c, _ in EXPORT_COLUMNS)
EMPTY = "\x01"
ROW_COLOURS = {"online": "d1fae5", "offline": "fee2e2"}


def inventory_export(devices: DataFrame) -> DataFrame:
    """The 14 export columns in their fixed order, in listing order; other columns are dropped."""
    return print_timestamps(in_listing_order(devices).select([c for c, _ in EXPORT_COLUMNS]))


def export_inventory_csv(devices: DataFrame, path: str) -> None:
    """Inventory as CSV part files with a header; the parts follow the listing order."""
    inventory_export(devices).write.mode("overwrite").option("header", True).csv(path)


def load_inventory_csv(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an exported inventory, and the ``place`` (from 1) that each has in it.

    Places come from the names of the files, where in a file a block starts, and the row's number in its block; blocks
    are read in parallel, and only their sizes are put in order.
    """
    # an empty text stands there in quotes, a NULL as nothing: the reader is told to keep them apart
    lines = spark.read.schema(EXPORT_SCHEMA).options(header=True, emptyValue=EMPTY).csv(path)
    lines = lines.withColumns({c: F.when(F.col(c) == EMPTY, "").otherwise(F.col(c)) for c, _ in EXPORT_COLUMNS if c != "id"})
    source = {"_file": F.col("_metadata.file_name"), "_start": F.col("_metadata.file_block_start")}
    # running numbers are consecutive within a block, as a task reads it from its start to its end
    rows = settled(lines.select("*", *(c.alias(n) for n, c in source.items()), F.monotonically_increasing_id().alias("_row")))
    blocks = rows.groupBy(*source).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy(*source).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*source, "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = (F.col("_before") + F.col("_row") - F.col("_first") + 1).alias("place")
    return rows.join(blocks, [*source]).select(*[c for c, _ in EXPORT_COLUMNS], place)


def inventory_report(devices: DataFrame) -> DataFrame:
    """Export rows under display headings, with the colour of the row."""
    colour = F.when(F.col("status") == "online", F.lit(ROW_COLOURS["online"])).when(
        F.col("status") == "offline", F.lit(ROW_COLOURS["offline"])
    )
    rows = inventory_export(devices)
    return rows.select([F.col(c).alias(heading) for c, heading in EXPORT_COLUMNS] + [colour.alias("row_color")])


def to_json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON object; timestamps as ``yyyy-MM-dd HH:mm:ss``, NULLs kept."""
    printed = print_timestamps(df)
    return printed.select(F.to_json(F.struct(*printed.columns), {"ignoreNullFields": "false"}).alias("json"))
