"""What the operators of this package share: words, byte sizes, row keys, tables in the shared folder."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.session import scratch_dir

GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"
#: Bits of the membership filter of ``semi_filtered``. Its table has at most BITS / 32 rows, whatever the data.
FILTER_BITS = 1 << 22


def shipped(module_name: str) -> None:
    """Send the functions of a module to the Python workers by value, so that they need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def kept_text(text: str | Column) -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_array(text: Column) -> Column:
    """The words of a text that is not null: runs of anything but ASCII white space."""
    trimmed = F.btrim(text, F.lit(GAP_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP, -1))


def word_count(text: Column) -> Column:
    """How many words a text that is not null has, without building them."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def byte_size(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """A table that later steps read more than once, in the folder that all executors share.

    Reading it again needs no lineage: a lost executor costs the tasks it ran, not the steps before.
    """
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def semi_filtered(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """``rows`` without most of those whose key is not in ``wanted``, before they are shuffled.

    A bit array of fixed size is what is broadcast, so its size does not grow with the data; what
    passes by accident is left to the join that follows.
    """

    def slot(k: Column) -> Column:
        return F.pmod(F.xxhash64(k), F.lit(FILTER_BITS))

    bits = (
        wanted.select(slot(wanted_key).alias("s"))
        .select(F.shiftright("s", 5).alias("__word"), F.pmod("s", F.lit(32)).cast("int").alias("b"))
        .groupBy("__word")
        .agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("__bits"))
    )
    s = rows.withColumn("__slot", slot(key)).withColumn("__word", F.shiftright("__slot", 5))
    hit = F.expr("shiftright(__bits, cast(pmod(__slot, 32) as int)) & 1L") == 1
    return s.join(F.broadcast(bits), "__word").where(hit).drop("__slot", "__word", "__bits")


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until no column is called so (capitals do not count)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
