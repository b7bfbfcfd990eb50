"""The monitoring loop: log every probe, find status changes, raise alerts, keep the state of each device."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetlens.operators.alerts import alert_rows
from fleetlens.operators.changes import apply_newest_status
from fleetlens.operators.flips import status_flips
from fleetlens.operators.ordering import time_and_id
from fleetlens.sources.tables import probe_schema
from fleetlens.streaming.probes import CHECK_INTERVAL

STATE = (
    "device_id bigint, checked_at timestamp, id bigint, is_online boolean, online_at timestamp, ignored_checks bigint"
)
MARKED = "id bigint, device_id bigint, checked_at timestamp, is_online boolean, response_ms int, ignored boolean"
FLIPS = "device_id bigint, id bigint, checked_at timestamp, alert_type string"
ALERTS = (
    "device_id bigint, alert_type string, message string, severity string, is_read boolean, created_at timestamp"
)
COMMITS = "seq bigint, run string, batch bigint, devices_since bigint"
#: One batch in so many writes the state of all devices; the others write only the devices that they saw.
FULL_EVERY = 64


def run_monitor(
    probes: DataFrame, out: str, checkpoint: str, devices: DataFrame | None = None, available_now: bool = False
) -> StreamingQuery:
    """Work through probe rows micro-batch by micro-batch.

    Below ``out``, each batch writes its own folder of ``uptime_log`` (all probes), ``flips`` (changes
    of state) and, if ``devices`` are given, ``alerts``. Folders are named by the id that the checkpoint holds and
    by batch, so a new checkpoint over the same ``out`` overwrites nothing and goes on from the last state.

    ``state`` (a device's newest check) and ``devices`` (status and last_seen after it) are kept as increments: a batch
    writes the devices that it saw, so what is written follows the batch and not the inventory. One batch in
    ``FULL_EVERY`` writes all of them, and the first one of a start all ``devices``, as the inventory may have changed. A reader
    takes the newest row per device since then. There are two rounds of places, which are overwritten by turns, and the
    commit that ends a batch says which is the last. A batch that is repeated after a failure reads what its
    predecessor left and writes the same content again. One run at a time may use ``out``.

    Checks not newer than a device's stored check are logged as ``ignored``, counted, and change
    nothing else. The work on a batch is the batch operator, so a batch may be a whole history, and a
    device may hold a large part of it.
    """
    spark = probes.sparkSession
    spark.createDataFrame([], COMMITS).write.mode("ignore").parquet(f"{out}/commits/start")

    whole_devices = [True]

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = json.loads(spark.read.text(f"{checkpoint}/metadata").first()["value"])["id"]
        others = [c for c in _commits(spark, out) if (c["run"], c["batch"]) != (run, batch_id)]
        seq = others[0]["seq"] + 1 if others else 0
        state = _state_of(spark, out, seq - 1) if others else spark.createDataFrame([], STATE)
        own = f"run={run}/batch={batch_id}"
        mark_old(batch, state).write.mode("overwrite").parquet(f"{out}/uptime_log/{own}")
        flips, after = step(spark.read.schema(MARKED).parquet(f"{out}/uptime_log/{own}"), state, all_devices=seq % FULL_EVERY == 0)
        flips.write.mode("overwrite").parquet(f"{out}/flips/{own}")
        _put(after, _place(f"{out}/state", seq), seq)
        since = None
        if devices is not None:
            found = spark.read.schema(FLIPS).parquet(f"{out}/flips/{own}")
            alert_rows(found, devices).write.mode("overwrite").parquet(f"{out}/alerts/{own}")
            since = seq if whole_devices[0] or seq % FULL_EVERY == 0 else others[0]["devices_since"]
            if since == seq:
                moved = apply_newest_status(devices, _state_of(spark, out, seq))
            else:
                news = _increments(spark, f"{out}/state", seq, seq, STATE)
                moved = apply_newest_status(devices.join(news.select(F.col("device_id").alias("id")), "id", "left_semi"), news)
            _put(moved.select(devices.columns), _place(f"{out}/devices", seq), seq)
        commit = spark.createDataFrame([(seq, run, batch_id, since)], COMMITS)
        commit.coalesce(1).write.mode("overwrite").parquet(f"{out}/commits/{seq % 2}")
        whole_devices[0] = False

    trigger = {"availableNow": True} if available_now else {"processingTime": CHECK_INTERVAL}
    return (
        probes.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def _commits(spark: SparkSession, out: str) -> list:
    """The commits of the last two batches, newest first."""
    return spark.read.schema(COMMITS).parquet(f"{out}/commits/*").orderBy(F.desc("seq")).collect()


def _place(table: str, seq: int) -> str:
    return f"{table}/{seq % (2 * FULL_EVERY)}"


def _put(rows: DataFrame, place: str, seq: int) -> None:
    rows.withColumn("written_by", F.lit(seq).cast("bigint")).write.mode("overwrite").parquet(place)


def _increments(spark: SparkSession, table: str, first: int, last: int, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(f"{schema}, written_by bigint") if schema else spark.read
    return reader.parquet(*(_place(table, s) for s in range(first, last + 1)))


def _newest(increments: DataFrame, key: str) -> DataFrame:
    """The rows of each key that were written last."""
    last = increments.groupBy(key).agg(F.max("written_by").alias("written_by"))
    return increments.join(last, [key, "written_by"], "left_semi").drop("written_by")


def _state_of(spark: SparkSession, out: str, seq: int) -> DataFrame:
    """The state of all devices after a batch: the last whole one and the increments since."""
    columns = [c.split()[0] for c in STATE.split(", ")]
    return _newest(_increments(spark, f"{out}/state", seq - seq % FULL_EVERY, seq, STATE), "device_id").select(columns)


def mark_old(checks: DataFrame, state: DataFrame) -> DataFrame:
    """Checks with ``ignored`` set where they are not newer than their device's stored check.

    The result is written as it is, so adaptive execution may split a device that fills a partition.
    """
    known = state.select("device_id", F.struct("checked_at", "id").alias("_known"))
    old = F.coalesce(F.struct("checked_at", "id") <= F.col("_known"), F.lit(False))
    return checks.join(known, "device_id", "left").select(*checks.columns, old.alias("ignored"))


def step(marked: DataFrame, state: DataFrame, all_devices: bool = True) -> tuple[DataFrame, DataFrame]:
    """The flips of one batch of marked checks against the state so far, and the state after it.

    Without ``all_devices`` the state is that of the devices in the batch.
    """
    fresh = ~F.col("ignored")
    flips = status_flips(marked.filter(fresh), state.select("device_id", "is_online"))
    place = F.when(fresh, time_and_id())
    news = marked.groupBy("device_id").agg(
        F.max(F.when(fresh, F.col("checked_at"))).alias("new_at"),
        F.max_by("id", place).alias("new_id"),
        F.max_by("is_online", place).alias("new_online"),
        F.max(F.when(fresh & F.col("is_online"), F.col("checked_at"))).alias("new_online_at"),
        F.count_if("ignored").alias("new_ignored"),
    )
    zero = F.lit(0).cast("bigint")
    after = state.join(news, "device_id", "full" if all_devices else "right").select(
        "device_id",
        F.coalesce("new_at", "checked_at").alias("checked_at"),
        F.coalesce("new_id", "id").alias("id"),
        F.coalesce("new_online", "is_online").alias("is_online"),
        F.coalesce("new_online_at", "online_at").alias("online_at"),
        (F.coalesce("ignored_checks", zero) + F.coalesce("new_ignored", zero)).alias("ignored_checks"),
    )
    return flips, after


def monitored_log(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(probe_schema()).parquet(f"{out}/uptime_log/run=*/batch=*")


def monitored_flips(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(FLIPS).parquet(f"{out}/flips/run=*/batch=*")


def monitored_alerts(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(ALERTS).parquet(f"{out}/alerts/run=*/batch=*")


def monitored_state(spark: SparkSession, out: str) -> DataFrame:
    """The state after the last batch."""
    return _state_of(spark, out, _commits(spark, out)[0]["seq"])


def monitored_devices(spark: SparkSession, out: str) -> DataFrame:
    """The devices with status and last_seen after the last batch, which must have been given devices."""
    last = _commits(spark, out)[0]
    if last["devices_since"] is None:
        raise ValueError(f"the last batch below {out} had no devices")
    return _newest(_increments(spark, f"{out}/devices", last["devices_since"], last["seq"]), "id")
