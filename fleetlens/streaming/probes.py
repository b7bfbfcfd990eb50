"""Streams of probe rows and what is kept about them in Spark's own state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from fleetlens.functions.numbers import percent
from fleetlens.operators.changes import newest_status
from fleetlens.operators.metrics import rows
from fleetlens.operators.ordering import first_rows_per_key
from fleetlens.sources.tables import probe_schema

LATENESS = "1 hour"
BYTES_PER_TRIGGER = 2 * 1024**3
CHECK_INTERVAL = "300 seconds"


def probe_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Probe rows as parquet files arrive. A micro-batch is limited by bytes, or by number of files."""
    limit = {"maxFilesPerTrigger": max_files} if max_files else {"maxBytesPerTrigger": BYTES_PER_TRIGGER}
    return spark.readStream.schema(probe_schema()).options(**limit).parquet(path)


def write_stream(df: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append a stream to a parquet table, every check interval or until the input is used up."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": CHECK_INTERVAL}
    return writer.trigger(**trigger).start(path)


def current_status(probes: DataFrame) -> DataFrame:
    """Newest state per device; as a stream, run it in update mode."""
    return newest_status(probes)


def _uptime_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "device_id",
        F.col("period.start").alias("window_start"),
        F.col("period.end").alias("window_end"),
        "total_checks",
        "online_checks",
        percent(F.col("online_checks"), F.col("total_checks")).alias("uptime_pct"),
    )


def _per_day(checks: DataFrame, lateness: str = LATENESS) -> DataFrame:
    return _days_of(checks.withWatermark("checked_at", lateness))


def _days_of(checks: DataFrame) -> DataFrame:
    by_day = checks.groupBy("device_id", F.window("checked_at", "1 day").alias("period"))
    return by_day.agg(rows().alias("total_checks"), F.count_if("is_online").alias("online_checks"))


def once_and_in_time(checks: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """A stream of checks without those that were sent again, and without those that come too late.

    Too late is more than ``lateness`` behind the newest check that was known when the micro-batch before began: so
    long Spark waits, as windows that the one before it closed are then out. How many it leaves out it reports; see
    ``feeds.late_rows``."""
    return checks.withWatermark("checked_at", lateness).dropDuplicatesWithinWatermark(["id"])


def daily_uptime_in_time(checks: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """``daily_uptime`` of a stream whose checks may be late or sent twice, in append mode: each day comes once."""
    return _uptime_columns(_days_of(once_and_in_time(checks, lateness)))


def daily_uptime(checks: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Uptime per device and day, batch or stream. In append mode a stream emits a day once it is ``lateness`` past;
    checks that come later than that are not counted."""
    return _uptime_columns(_per_day(checks, lateness))


def sliding_uptime(checks: DataFrame, days: int = 7) -> DataFrame:
    """Uptime per device over the last ``days`` days, moved on by a day.

    Built on the daily sums, so a check is not copied into each of its windows.
    """
    return _slid(_per_day(checks).withColumn("at", F.window_time("period")), days)


def closing_check(checks: DataFrame, days: int = 7, lateness: str = LATENESS) -> DataFrame:
    """A check of no device, so far behind the others that every window of ``days`` days with one of them closes.

    A feed that ends is sent it last. Its own windows stay open, so they never come out. None where there are no checks.
    """
    newest = checks.agg(F.max("checked_at").alias("checked_at")).filter("checked_at is not null")
    after = (F.col("checked_at") + F.expr(f"INTERVAL {days + 1} DAYS") + F.expr(f"INTERVAL {lateness}")).alias("checked_at")
    return newest.select(*(after if field.name == "checked_at" else F.lit(None).cast(field.dataType).alias(field.name) for field in checks.schema))


def sliding_of_days(daily: DataFrame, days: int = 7) -> DataFrame:
    """The same from rows of ``daily_uptime``, batch only; no window waits to be closed."""
    return _slid(daily.withColumn("at", F.col("window_start").cast("timestamp")), days)


def _slid(per_day: DataFrame, days: int) -> DataFrame:
    slid = per_day.groupBy("device_id", F.window("at", f"{days} days", "1 day").alias("period")).agg(
        F.sum("total_checks").alias("total_checks"), F.sum("online_checks").alias("online_checks")
    )
    return _uptime_columns(slid)


def write_updates(df: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Write what each micro-batch changes in a grouped stream to a folder of its own; see ``newest_updates``.

    In append mode a window waits until the watermark has passed its end, so the last ones of an input that ends
    are never written. Here each window is written as it stands whenever it changes.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = df.writeStream.foreachBatch(on_batch).outputMode("update").option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": CHECK_INTERVAL}
    return writer.trigger(**trigger).start()


def newest_updates(spark: SparkSession, path: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """The last row written for each key."""
    every = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    return first_rows_per_key(every, keys, [F.desc("batch")]).select(schema.names)


def daily_alerts(alerts: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Alerts per day, type and severity, batch or stream."""
    return (
        alerts.withWatermark("created_at", lateness)
        .groupBy(F.window("created_at", "1 day").alias("period"), "alert_type", "severity")
        .agg(rows().alias("n_alerts"))
        .select(F.col("period.start").alias("window_start"), "alert_type", "severity", "n_alerts")
    )


FLIP_SCHEMA = T.StructType(
    [
        T.StructField("device_id", T.LongType()),
        T.StructField("id", T.LongType()),
        T.StructField("checked_at", T.TimestampType()),
        T.StructField("alert_type", T.StringType()),
        T.StructField("ignored_checks", T.LongType()),
    ]
)
LAST_CHECK = T.StructType(
    [
        T.StructField("at", T.LongType()),
        T.StructField("id", T.LongType()),
        T.StructField("is_online", T.BooleanType()),
        T.StructField("ignored", T.LongType()),
    ]
)


class FlipProcessor(StatefulProcessor):
    """Keeps the last check of a device and emits its changes of state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last_check", LAST_CHECK)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        at, number, was, ignored = self._last.get() if self._last.exists() else (None, None, None, 0)
        flips = []
        for micros, check, online in sorted((r.at, r.id, r.is_online) for r in rows):
            if at is not None and (micros, check) <= (at, number):
                ignored += 1
                continue
            if was is not None and online != was:
                flips.append((check, micros, "back_online" if online else "offline"))
            at, number, was = micros, check, online
        self._last.update((at, number, was, ignored))
        for check, micros, kind in flips:
            yield Row(device_id=key[0], id=check, at=micros, alert_type=kind, ignored_checks=ignored)

    def close(self) -> None:
        pass


def flip_stream(probes: DataFrame) -> DataFrame:
    """Changes of state as they arrive, with the last check of each device in Spark's state store (RocksDB).

    Only the devices of a micro-batch are read and written there, and their changes are all that a batch uploads, so
    its cost follows the batch and not the inventory. For live probes: a micro-batch holds a few rows per device, and
    its size is limited by ``probe_stream``. The first check of a device is silent. Checks older than the stored one
    are ignored and counted. Use ``run_monitor`` to work through a long history.
    """
    # moments as whole numbers, so that no time zone of a worker touches them
    checks = probes.select("device_id", "id", F.unix_micros(F.col("checked_at").cast("timestamp")).alias("at"), "is_online")
    flips = checks.groupBy("device_id").transformWithState(
        statefulProcessor=FlipProcessor(),
        outputStructType="device_id bigint, id bigint, at bigint, alert_type string, ignored_checks bigint",
        outputMode="Append",
        timeMode="None",
    )
    return flips.select("device_id", "id", F.timestamp_micros("at").alias("checked_at"), "alert_type", "ignored_checks")


def use_rocksdb(spark: SparkSession) -> None:
    """State store on disk: ``flip_stream`` needs it, large windows want it. Set before a query starts.

    Changes are logged per batch instead of copying the whole state, and its rows are not counted.
    """
    store = "spark.sql.streaming.stateStore"
    spark.conf.set(
        f"{store}.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
    spark.conf.set(f"{store}.rocksdb.changelogCheckpointing.enabled", "true")
    spark.conf.set(f"{store}.rocksdb.trackTotalNumberOfRows", "false")
