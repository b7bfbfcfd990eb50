"""Feeds that come in parts, and what a stream reports about them."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Files of a part, at most, and rows that a file has at least where a part has several.
MOST_FILES, ROWS_PER_FILE = 64, 1000


@dataclass
class Feed:
    """A folder of files; each run of ``files_per_part`` of them, in the order of writing, is one part."""

    path: str
    files_per_part: int
    parts: list
    rows: DataFrame

    def stream(self) -> DataFrame:
        """The feed as a stream with a micro-batch for each part."""
        reader = self.rows.sparkSession.readStream.schema(self.rows.schema)
        return reader.option("maxFilesPerTrigger", self.files_per_part).parquet(self.path)

    def end_with(self, rows: DataFrame) -> None:
        """Add a last part."""
        rows.coalesce(1).write.mode("append").parquet(self.path)

    def reports(self, query: StreamingQuery) -> list[tuple[object, dict]]:
        """(part, report) of the micro-batches that had rows; the others only move windows on."""
        every = [json.loads(p.json) for p in query.recentProgress]
        return list(zip(self.parts, [r for r in every if r["numInputRows"]], strict=False))


def written_in_parts(rows: DataFrame, part: Column, folder: str) -> Feed:
    """Write the rows of each part, in the order of parts, as files of a feed; every part has the same number of them.

    The rows are first stored by part, so what they are made of is read once, however many parts there are.
    """
    spark = rows.sparkSession
    by_part = rows.withColumn("part", part)
    by_part.write.partitionBy("part").parquet(f"{folder}/staged")
    staged = spark.read.schema(by_part.schema).parquet(f"{folder}/staged")
    counts = staged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    files = max(1, min([MOST_FILES, *(r["n"] // ROWS_PER_FILE for r in counts)]))
    values = [r["part"] for r in counts]
    for value in values or [None]:
        arrived = staged.filter(F.col("part").eqNullSafe(F.lit(value))).drop("part")
        arrived.repartition(files).write.mode("append").parquet(f"{folder}/feed")
    return Feed(f"{folder}/feed", files, values, rows)


def late_rows(report: dict) -> int:
    """Rows that a micro-batch left out because they came too late."""
    return sum(s.get("numRowsDroppedByWatermark", 0) for s in report.get("stateOperators", []))
