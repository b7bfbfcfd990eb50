"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import kept_text, unused, word_count, written

#: No document is used more often.
EPOCHS = 3
#: Weights of the sources in their order, repeating.
WEIGHTS = [1, 2, 3]
#: Hexadecimal digits of a row's shuffle key that name its run. 4096 runs cut each source into pieces for one task.
RUN_DIGITS = 3


def source_targets(sized: DataFrame, weights: list[int], epochs: int) -> DataFrame:
    """One row per source (``no_name``, ``name``): its size and its target.

    The budget is the size of all sources. A source is full at ``epochs`` times its size. Sources are sorted
    by the common level at which they fill up; those below the final level take their limit, the others share
    what is left by weight, which is where giving back the excess again and again ends. The windows run over
    one row per source.
    """
    sources = sized.groupBy("no_name", "name").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy("no_name", "name")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    by_level = Window.orderBy(F.expr("cap / weight"), "no_name", "name")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    return (
        sources.withColumn("weight", weight.cast("long"))
        .withColumn("cap", epochs * F.col("source_size"))
        .withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("level", F.col("left") / F.sum("weight").over(onward))
        .withColumn("final", F.max(F.expr("if(cap > level * weight, level, null)")).over(everything))
        .select(
            "no_name",
            "name",
            "source_size",
            F.expr("least(cast(cap as double), coalesce(final * weight, cast(cap as double)))").alias("target"),
        )
    )


def mixture(
    docs: DataFrame,
    carried: list[str],
    weights: list[int] = WEIGHTS,
    epochs: int = EPOCHS,
    id_col: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: the ``carried`` columns, size in words, source_size, target, queued, copies.

    The documents of a source queue in a shuffled order, once per epoch. A copy's virtual finish time is the
    number of words queued up to its end, divided by the target of its source. With the targets as weights
    the whole budget is spent at time 1, so the list of all copies, sorted by that time, is cut there: a copy
    is taken if the middle of its words is due by time 1. So each source misses its target by half a
    document at most.

    A running sum over a source is that of its runs plus that within the run; no task sees a whole source.
    A null source is a source of its own and the last; a null text has no words and is taken 0 times; ids may
    be null or repeated, and equal rows are interchangeable. An empty table gives an empty result.
    """
    t = kept_text(f"`{text}`")
    name = F.col(f"`{source}`")
    sized = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in carried)).alias("row"),
        name.isNull().alias("no_name"),
        F.coalesce(name, F.lit("")).alias("name"),
        word_count(t).alias("size"),
        F.md5(F.concat_ws("|", F.col(f"`{id_col}`").cast("string"), F.md5(t.cast("binary"))).cast("binary")).alias("h"),
    )
    sized = written(sized, "mix-sizes").withColumn("run", F.substring("h", 1, RUN_DIGITS))
    runs = sized.groupBy("no_name", "name", "run").agg(F.sum("size").alias("run_size"))
    ahead = Window.partitionBy("no_name", "name").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("no_name", "name", "run", F.coalesce(F.sum("run_size").over(ahead), F.lit(0)).alias("ahead"))
    targets = source_targets(runs.withColumnRenamed("run_size", "size"), weights, epochs)
    starts = starts.join(targets, ["no_name", "name"])
    in_run = Window.partitionBy("no_name", "name", "run").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queued = sized.withColumn("in_run", F.sum("size").over(in_run)).join(starts, ["no_name", "name", "run"])
    queued = queued.withColumn("queued", F.col("ahead") + F.col("in_run"))
    due = F.filter(
        F.sequence(F.lit(0), F.lit(epochs - 1)),
        lambda e: 2 * (e * F.col("source_size") + F.col("queued")) - F.col("size") <= 2 * F.col("target"),
    )
    copies = F.when(F.col("size") > 0, F.size(due)).otherwise(0).cast("int")
    return queued.select("row.*", "size", "source_size", "target", "queued", copies.alias("copies"))


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` as the mix takes them, repeats included, sorted by virtual finish time over all files."""
    row = unused(docs.columns, "whole_row")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row), *(F.col(f"`{c}`") for c in docs.columns))
    chosen = mixture(whole, [row], **settings).where("copies > 0")
    copies = chosen.withColumn("e", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    copies = copies.withColumn("finish", (F.col("e") * F.col("source_size") + F.col("queued")) / F.col("target"))
    return copies.repartitionByRange("finish").sortWithinPartitions("finish").select(f"`{row}`.*")
