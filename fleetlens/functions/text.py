"""Text helpers: search, address encoding, durations, printed timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIMESTAMP_TEXT = "yyyy-MM-dd HH:mm:ss"


def is_blank(column: Column) -> Column:
    """NULL or empty text."""
    return column.isNull() | (column == "")


def or_else(column: Column, fallback: Column) -> Column:
    """``fallback`` where ``column`` is NULL or empty."""
    return F.when(is_blank(column), fallback).otherwise(column)


def contains_text(columns: list[str], needle: str | None) -> Column:
    """Case-insensitive substring test over several columns, NULL read as ''. No wildcards."""
    if not needle:
        return F.lit(True)
    wanted = F.lit(needle.lower())
    hit = F.lit(False)
    for name in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(name), F.lit(""))), wanted)
    return hit


def address_from_url(column: Column) -> Column:
    """``10-0-0-1`` as it stands in links -> ``10.0.0.1``."""
    return F.translate(column, "-", ".")


def address_to_url(column: Column) -> Column:
    return F.translate(column, ".", "-")


def duration_text(started: Column, finished: Column) -> Column:
    """``42s`` below a minute, else whole minutes ``3m``; NULL while unfinished.

    Both ends are read at whole seconds, as they are printed; minutes round half up.
    """
    seconds = F.unix_timestamp(finished.cast("timestamp")) - F.unix_timestamp(started.cast("timestamp"))
    minutes = F.floor((seconds + 30) / 60).cast("bigint")
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s"))).otherwise(
        F.concat(minutes.cast("string"), F.lit("m"))
    )


def print_timestamps(df: DataFrame) -> DataFrame:
    """Every timestamp column as ``yyyy-MM-dd HH:mm:ss`` text (fractions cut); dates as ISO text."""
    printed = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            printed[field.name] = F.date_format(F.col(field.name), TIMESTAMP_TEXT)
        elif isinstance(field.dataType, T.DateType):
            printed[field.name] = F.date_format(F.col(field.name), "yyyy-MM-dd")
    return df.withColumns(printed) if printed else df
