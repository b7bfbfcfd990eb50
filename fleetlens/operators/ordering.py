"""Order-dependent building blocks that never put a whole group or table into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.session import settled

SALTS = 64
#: More than the distance of any two 64-bit ids.
ID_SPAN = 2 * 10**19


def time_and_id(time: str = "checked_at", number: str = "id") -> Column:
    """One whole number that orders rows as (time, id) does.

    Unlike a struct, a hash aggregate can hold it as the order of ``max_by``, without sorting all rows first.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp")).cast("decimal(18,0)")
    return micros * F.lit(str(ID_SPAN)).cast("decimal(20,0)") + F.col(number).cast("decimal(19,0)")


def first_rows_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, number: str = "row_no") -> DataFrame:
    """The first ``n`` rows of each key under a total order, numbered from 1.

    Spark prunes ``row_number() <= n`` to ``n`` rows per key inside every map task before the shuffle,
    so a key that fills a third of the table still sends few rows. It only does so up to a threshold;
    for a larger ``n`` the same pruning is done by hand over salted sub-groups first.
    """
    threshold = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    columns = df.columns
    if n > threshold:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in columns]), F.lit(SALTS)))
        within = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn("_nth", F.row_number().over(within)).filter(F.col("_nth") <= n).select(columns)
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(number, F.row_number().over(window)).filter(F.col(number) <= n)


def rank_by_histogram(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """``rank() over (partition by <by> order by <value> desc)`` through the histogram of the values.

    Only the distinct (by, value) pairs pass through a window. For counts these are few: ``d``
    different counts need at least ``d * (d + 1) / 2`` counted rows. Neither ``by`` nor ``value`` may
    be NULL.
    """
    histogram = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    above = Window.partitionBy(*by).orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranks = histogram.select(*by, value, (F.coalesce(F.sum("_n").over(above), F.lit(0)) + 1).cast("bigint").alias(out))
    return df.join(ranks, [*by, value])


def with_positions(df: DataFrame, coarse: Column, fine: Column, order: list[Column]) -> DataFrame:
    """Place of each row in one total order over the whole frame, without a single-task window.

    The order is (coarse, fine, order). Rows are counted per (coarse, fine) bucket, running sums over
    the counts give each bucket's offset, and rows are numbered inside their bucket only. The caller
    picks buckets that are bounded: few values of ``coarse``, few buckets per ``coarse`` value, few
    rows per bucket.

    Adds ``position`` (from 1), ``before`` (rows with a smaller ``coarse``) and ``total``.
    """
    columns = df.columns
    tagged = df.withColumns({"_coarse": coarse, "_fine": fine})
    buckets = tagged.groupBy("_coarse", "_fine").agg(F.count(F.lit(1)).alias("_n"))
    groups = buckets.groupBy("_coarse").agg(F.sum("_n").alias("_n"))
    earlier = Window.orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(
        "_coarse",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("before"),
        F.sum("_n").over(Window.partitionBy()).alias("total"),
    )
    inner = Window.partitionBy("_coarse").orderBy("_fine").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("_coarse", "_fine", F.coalesce(F.sum("_n").over(inner), F.lit(0)).alias("_skip"))
    offsets = offsets.join(groups, "_coarse")
    within = Window.partitionBy("_coarse", "_fine").orderBy(*order)
    numbered = tagged.withColumn("_nth", F.row_number().over(within)).join(offsets, ["_coarse", "_fine"])
    position = (F.col("before") + F.col("_skip") + F.col("_nth")).alias("position")
    return numbered.select(*columns, position, "before", "total")


def positions_by_range(df: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ``position`` (from 1) in a total order that has no natural buckets.

    Spark samples the order for borders, each task sorts one range, and the sizes of the ranges before give its offset.
    Rows that are equal in the whole order are told apart by where they come from, so that a group of them may be
    split; they are interchangeable. Pass a frame that gives the same rows in the same places when it is read again,
    such as a settled one. Starts a job.
    """
    columns = df.columns
    by = [*order, F.col("_tie")]
    ranged = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    # the lower 33 bits of the running number count the rows of a partition
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = settled(ranged.select(*columns, F.spark_partition_id().alias("_part"), at.alias("_at")))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    position = (F.col("_start") + F.col("_at") + 1).alias("position")
    return placed.join(F.broadcast(starts), "_part").select(*columns, position)  # one row of starts per partition
