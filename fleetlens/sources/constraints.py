"""Constraint audit: the rules a database server enforces, as a report of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.sources.schemas import CONSTRAINTS, TABLES


def _row_rules(name: str) -> list[tuple[str, str, Column]]:
    spec = CONSTRAINTS[name]
    rules = [("not_null", f.name, F.col(f.name).isNull()) for f in TABLES[name].fields if not f.nullable]
    rules += [("allowed", c, ~F.col(c).isin(*values)) for c, values in spec.allowed.items()]
    rules += [("length", c, F.length(c) > n) for c, n in spec.max_length.items()]
    return rules


def _entries(name: str, parents: dict[str, DataFrame], first: int) -> tuple[list[tuple[str, str, str]], list[Column], dict]:
    """The rules of a table, what a row enters for each, and the numbers of rules by (parent, key column)."""
    spec = CONSTRAINTS[name]
    rules, entries, keys = [], [], {}

    def entry(rule: str, column: str, test: Column, key: Column) -> Column:
        number = F.lit(first + len(rules))
        rules.append((name, rule, column))
        return F.when(test, F.struct(number.alias("number"), key.alias("key")))

    for rule, column, test in _row_rules(name):
        entries.append(entry(rule, column, test, F.lit(None).cast("string")))
    for column in spec.unique:
        entries.append(entry("unique", column, F.col(column).isNotNull(), F.col(column).cast("string")))
    for column, parent, key in spec.foreign:
        if parent in parents:
            keys.setdefault((parent, key), []).append(first + len(rules))
            entries.append(entry("foreign_key", column, F.col(column).isNotNull(), F.col(column).cast("string")))
    return rules, entries, keys


def audit_tables(tables: dict[str, DataFrame], parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row (table_name, rule, column_name, violations) per rule of every table, from one pass over each.

    A row enters the number of each row rule that it breaks, and each of its keys; parents enter their keys for every
    rule that asks for them. All
    entries are counted per (rule, key) by one shuffle for all tables, in every task first, so a key that fills
    most of a table is one row of it. ``unique`` counts the surplus rows of repeated keys, ``foreign_key`` the rows
    whose parent is missing. Foreign keys into tables that ``parents`` does not have are not judged.
    """
    parents = parents or {}
    rules: list[tuple[str, str, str]] = []
    entered: list[DataFrame] = []
    asked: dict[tuple[str, str], list[int]] = {}
    for name, df in tables.items():
        own, entries, keys = _entries(name, parents, len(rules))
        rules += own
        broken = df.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*", F.lit(False).alias("is_parent"))
        entered.append(broken)
        for k, numbers in keys.items():
            asked.setdefault(k, []).extend(numbers)
    for (parent, key), numbers in asked.items():
        known = parents[parent].filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"))
        every_rule = F.explode(F.array(*map(F.lit, numbers))).alias("number")
        entered.append(known.select(every_rule, "key", F.lit(True).alias("is_parent")))
    per_key = reduce(DataFrame.unionByName, entered).groupBy("number", "key").agg(
        F.count_if(~F.col("is_parent")).alias("n"), F.max("is_parent").alias("known")
    )
    counted = per_key.groupBy("number").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("surplus"), F.sum(F.when(~F.col("known"), F.col("n"))).alias("orphans")
    )
    listed = ", ".join(f"struct({i} AS number, '{t}' AS table_name, '{r}' AS rule, '{c}' AS column_name)" for i, (t, r, c) in enumerate(rules))
    every = per_key.sparkSession.range(1).select(F.expr(f"inline(array({listed}))"))
    violations = F.when(F.col("rule") == "unique", F.col("surplus")).when(F.col("rule") == "foreign_key", F.col("orphans")).otherwise(F.col("n"))
    return every.join(counted, "number", "left").select(
        "table_name", "rule", "column_name", F.coalesce(violations, F.lit(0).cast("bigint")).alias("violations")
    )


def audit_constraints(df: DataFrame, name: str, parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """The rules of one table; see ``audit_tables``."""
    return audit_tables({name: df}, parents)
