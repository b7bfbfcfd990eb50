"""Spark result against SQL result, without regard to row order."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import DataFrame

GIVEN = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def sql_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in GIVEN:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, values as comparable text, rows sorted."""
    df = df[sorted(df.columns)].copy()
    for column in df.columns:
        values = df[column]
        if pd.api.types.is_float_dtype(values):
            values = values.round(9)
        df[column] = values.map(lambda v: "NULL" if v is None or v is pd.NaT or v != v else _text(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def _text(value) -> str:
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    if hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    return str(value)


def difference(spark_df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both agree, else what differs."""
    left, right = spark_df.toPandas(), con.execute(sql).df()
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} against {sorted(right.columns)}"
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}"
    left, right = normal(left), normal(right)
    if left.equals(right):
        return None
    unlike = (left != right).any(axis=1)
    columns = [c for c in left.columns if (left[c] != right[c]).any()]
    both = pd.concat([left[unlike].head(3), right[unlike].head(3)])
    return f"{unlike.sum()} rows differ in {columns}\n{both.to_string()}"
