from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.operators.ordering import first_rows_per_key, rank_by_histogram, time_and_id, with_positions
from fleetlens.operators.ranking import bucket_of


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows belong to key 0."""
    rng = random.Random(1)
    rows = [(0 if i % 3 == 0 else rng.randrange(1, 40), rng.randrange(0, 60), i) for i in range(3000)]
    return spark.createDataFrame(rows, "k int, v int, id long").cache()


def test_positions_equal_the_plain_window(skewed):
    found = with_positions(skewed, F.col("v"), F.call_function("div", F.col("id"), F.lit(500)), [F.col("id")])
    plain = skewed.select(
        "id",
        F.row_number().over(Window.orderBy("v", "id")).alias("position"),
        (F.rank().over(Window.orderBy("v")) - 1).alias("before"),
    )
    assert {tuple(r) for r in found.select("id", "position", "before").collect()} == {tuple(r) for r in plain.collect()}
    assert [r.total for r in found.select("total").distinct().collect()] == [3000]


def test_positions_plan_has_no_single_task_over_all_rows(skewed):
    """Only the counts per coarse value may pass through one task."""
    found = with_positions(skewed, F.col("v"), F.col("k"), [F.col("id")])
    plan = final_plan(found).split("== Initial Plan ==")[0]
    for line in plan.splitlines():
        assert not ("row_number" in line and "windowspecdefinition(id" in line)


def test_rank_by_histogram_equals_rank(skewed):
    found = rank_by_histogram(skewed, "v", ["k"], "place").select("id", "place")
    plain = skewed.select("id", F.rank().over(Window.partitionBy("k").orderBy(F.desc("v"))).alias("place"))
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in plain.collect()}


@pytest.mark.parametrize("n", [1, 24, 1500])
def test_first_rows_per_key(skewed, n):
    """Also above the size up to which Spark prunes by itself."""
    found = first_rows_per_key(skewed, ["k"], [F.desc("v"), F.desc("id")], n)
    window = Window.partitionBy("k").orderBy(F.desc("v"), F.desc("id"))
    plain = skewed.withColumn("row_no", F.row_number().over(window)).filter(F.col("row_no") <= n)
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in plain.collect()}


def test_first_rows_are_pruned_before_the_shuffle(skewed):
    plan = final_plan(first_rows_per_key(skewed, ["k"], [F.desc("v"), F.desc("id")], 24))
    assert plan.count("WindowGroupLimit") >= 2


def test_time_and_id_orders_like_both(spark):
    times = ["0001-01-01 00:00:00", "1969-12-31 23:59:59.999999", "1970-01-01 00:00:00", "2024-05-01 12:00:00", "9999-12-31 23:59:59"]
    ids = [-(2**63), -1, 0, 7, 2**63 - 1]
    rows = spark.createDataFrame([(t, i) for t in times for i in ids], "t string, id long")
    rows = rows.withColumn("checked_at", F.col("t").cast("timestamp")).withColumn("place", time_and_id())
    found = [(r.t, r.id) for r in rows.orderBy("place").select("t", "id").collect()]
    assert found == sorted(found) and rows.select("place").distinct().count() == len(found)


def test_quartiles_equal_ntile(spark):
    sizes = [1, 2, 3, 4, 5, 6, 7, 8, 97, 98, 99, 100]
    rows = [(n, i) for n in sizes for i in range(1, n + 1)]
    df = spark.createDataFrame(rows, "total long, position long")
    plain = F.ntile(4).over(Window.partitionBy("total").orderBy("position"))
    unlike = df.withColumns({"a": bucket_of(F.col("position"), F.col("total"), 4), "b": plain}).filter("a <> b")
    assert unlike.count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 3)), min_size=1, max_size=40))
def test_positions_of_any_rows(spark, rows):
    df = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(rows)], "a int, b int, id long")
    found = with_positions(df, F.col("a"), F.col("b"), [F.col("id")]).collect()
    in_order = sorted((r.a, r.b, r.id) for r in found)
    assert [(r.a, r.b, r.id) for r in sorted(found, key=lambda r: r.position)] == in_order
    assert sorted(r.position for r in found) == list(range(1, len(rows) + 1))
