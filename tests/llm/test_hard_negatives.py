"""Hard negatives against all products, and exact products against whole numbers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import hard_negatives as hn
from fleetlens.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def brute_force(rows, positives=5, negatives=3):
    """rows: (id, vector, label), labels as they count."""
    whole = [
        (i, [math.floor(256 * x) for x in v], label)
        for i, v, label in rows
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    anchors = {}
    for i, v, label in whole:
        if i is not None and i % 50 == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    out = []
    for a, (own, v) in anchors.items():
        scored = [(-sum(x * y for x, y in zip(v, w, strict=False)), i is None, i or 0, i, label) for i, w, label in whole if i != a]
        scored.sort(key=lambda r: r[:3])
        for p in [s for s in scored if s[4] == own][:positives]:
            ps = -p[0]
            fit = [s for s in scored if s[4] != own and 50 * ps <= -100 * s[0] <= 95 * ps][:negatives]
            out += [(a, p[3], k, s[3], ps, -s[0]) for k, s in enumerate(fit, 1)]
    return out


def by_value(rows):
    return sorted(rows, key=lambda r: [(x is None, x or 0) for x in r])


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    moved = [(i, v, (y + 1) % 10 if y is not None and i % 7 == 0 else y) for i, v, y in rows]
    found = [tuple(r) for r in QUERIES["op13_hard_negatives"](spark, DATA).collect()]
    assert found and by_value(found) == by_value(brute_force(moved))


SCHEMA = "vec_id long, embedding array<float>, label int, a int, r int, row string, id string, v int, score int"


@pytest.mark.parametrize("block", [4, 8192])
def test_odd_rows_ties_and_small_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(hn, "ROW_BLOCK", block)
    monkeypatch.setattr(hn, "STRIPE", 2)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6) / 2], int(rng.integers(3))) for i in range(0, 400, 5)]
    rows += [(7, None, 1), (8, [1.0, None], 1), (9, [float("nan")] * 6, 1), (11, [float("inf")] * 6, 2), (12, [1.0] * 6, None)]
    rows += [(None, [1.0] * 6, 1), (50, rows[0][1], 1), (13, [1.0, 0.5], 2), (14, [], 0), *rows[:20]]
    wide = [(*r, 1, 2, "x", "y", 3, 4) for r in rows]
    found = hn.hard_negatives(spark.createDataFrame(wide, SCHEMA).repartition(3), F.col("vec_id") % 50 == 0)
    got = [tuple(r) for r in found.collect()]
    want = brute_force(rows)
    # repeated rows share ids and scores, so equal rows may stand for each other
    assert by_value(got) == by_value(want)


def test_without_anchors_or_rows(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>, label string")
    assert hn.hard_negatives(none, F.col("vec_id") % 50 == 0).collect() == []
    one = spark.createDataFrame([(50, [1.0], "a")], none.schema)
    assert hn.hard_negatives(one, F.col("vec_id") % 50 == 0).collect() == []
    assert hn.hard_negatives(one, F.col("vec_id") == 3).collect() == []


def test_large_components(spark):
    rows = [(i, [float((i * 37) % 101 - 50) * 1000.0, float(i)], i % 2) for i in range(0, 120, 3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert by_value(tuple(r) for r in hn.hard_negatives(frame, F.col("vec_id") % 50 == 0).collect()) == by_value(brute_force(rows))
    with pytest.raises(OverflowError):
        hn.hard_negatives(frame, F.col("vec_id") % 50 == 0, scale=10**9)


@pytest.mark.parametrize("width", [1, 64, 1024, 2500])
def test_exact_products(width):
    rng = np.random.default_rng(width)
    a, b = rng.integers(-4000, 4001, (5, width)), rng.integers(-4000, 4001, (7, width))
    bound = width * 4000**2
    primes = hn.primes_for(bound, width)
    assert math.prod(primes) > 2 * bound
    got = hn.exact_scores([hn.residues(a, p) for p in primes], [hn.residues(b, p) for p in primes], primes)
    assert (got == a @ b.T).all()
