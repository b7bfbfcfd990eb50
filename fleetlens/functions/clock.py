"""Points in time. Operators never call "now" on their own: they take ``as_of``."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

AsOf = datetime | str | None


def moment(as_of: AsOf, like: T.DataType | None = None) -> Column:
    """``as_of`` as a literal of the compared column's own type.

    Giving the literal the type of the column (``timestamp`` or ``timestamp_ntz``) keeps the column
    itself free of casts, so that the comparison reaches the parquet scan. ``None`` means now.
    """
    base = F.current_timestamp() if as_of is None else F.lit(str(as_of))
    return base.cast(like or T.TimestampType())


def days_before(as_of: AsOf, days: int, like: T.DataType | None = None) -> Column:
    """A sliding instant ``days`` days before ``as_of`` (not midnight)."""
    return moment(as_of, like) - F.make_dt_interval(F.lit(days))


def type_of(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType
