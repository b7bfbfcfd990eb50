"""Hard negatives: rows of other labels that score close below an anchor's positives, by exact integer products."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import shipped, written
from fleetlens.operators.ordering import first_rows_per_key

POSITIVES = 5
NEGATIVES = 3
#: A negative's score lies between these percentages of the positive's.
LOW, HIGH = 50, 95
SCALE = 256
#: Rows and anchors of a block, at most, and values of a block's matrix. A task sees one block of each.
ROW_BLOCK, ANCHOR_BLOCK, BLOCK_VALUES = 8192, 1024, 1 << 20
#: Anchors that are multiplied with a block at once.
STRIPE = 128
#: Components that are summed in float32 before a remainder is taken.
SLICE = 1024
#: float32 holds whole numbers up to here.
EXACT = 1 << 24
#: Greatest inner product, in amount. The product of the primes stays within 63 bits.
MOST = 1 << 51
_LEAST = np.iinfo(np.int64).min
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def primes_for(bound: int, n_components: int) -> list[int]:
    """Primes, largest first, whose products of residues stay exact in float32, and whose product tells apart all
    whole numbers from -bound to bound."""
    largest = 1
    while min(max(n_components, 1), SLICE) * ((largest + 1) // 2) ** 2 < EXACT:
        largest += 2
    primes, product = [], 1
    for p in range(largest - 2, 1, -1):
        if product > 2 * bound:
            break
        if all(p % q for q in range(2, int(p**0.5) + 1)):
            primes.append(p)
            product *= p
    return primes


def residues(values: np.ndarray, prime: int) -> np.ndarray:
    """Residues around 0, as float32."""
    r = values % prime
    return np.where(r > prime // 2, r - prime, r).astype(np.float32)


def exact_scores(anchors: list[np.ndarray], rows: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Inner products of all anchors with all rows, from their residues for each prime.

    One float32 matrix product for each prime and slice of components; the remainders are then put together one prime
    after another (Chinese remaindering in mixed radix), and the upper half stands for the negative numbers.
    """
    total = np.zeros((anchors[0].shape[0], rows[0].shape[0]), np.int64)
    product = 1
    for p, a, b in zip(primes, anchors, rows, strict=True):
        r = np.zeros_like(total)
        for s in range(0, a.shape[1], SLICE):
            r += (a[:, s : s + SLICE] @ b[:, s : s + SLICE].T).astype(np.int64)
        total += product * ((r - total) % p * pow(product, -1, p) % p)
        product *= p
    return np.where(total > product // 2, total - product, total)


def best_of_rows(score: np.ndarray, valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` highest valid entries of each row; of equal ones the first columns."""
    m, n = score.shape
    if n > k:
        kth = np.partition(np.where(valid, score, _LEAST), n - k, axis=1)[:, n - k]
        valid = valid & (score >= kth[:, None])
    row, column = np.nonzero(valid)
    order = np.lexsort((column, -score[row, column], row))
    row, column = row[order], column[order]
    nth = np.arange(len(row)) - np.searchsorted(row, np.arange(m))[row]
    return row[nth < k], column[nth < k]


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    array = lists.combine_chunks()
    sizes = array.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(array), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = array.flatten().to_numpy(zero_copy_only=False)
    return out


class Cell:
    """A block of anchors against a block of rows, the rows in the order of their ids, null last."""

    def __init__(self, anchors: pa.Table, rows: pa.Table, width: int, primes: list[int]):
        self.anchors = anchors
        self.rows = rows = rows.sort_by([("id", "ascending")])
        labels = pa.concat_arrays([t["label"].combine_chunks() for t in (anchors, rows)]).dictionary_encode().indices
        labels = labels.to_numpy(zero_copy_only=False)
        self.own, self.other = labels[: len(anchors)], labels[len(anchors) :]
        ids = rows["id"].combine_chunks()
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        a, b = _matrix(anchors["v"], width), _matrix(rows["v"], width)
        self.a, self.b = [residues(a, p) for p in primes], [residues(b, p) for p in primes]
        self.primes = primes

    def stripes(self):
        """(first anchor, scores, whether labels agree) of a few anchors at a time."""
        for s in range(0, len(self.anchors), STRIPE):
            some = slice(s, s + STRIPE)
            same = self.own[some, None] == self.other[None, :]
            yield some, exact_scores([a[some] for a in self.a], self.b, self.primes), same


def _in_cells(anchors: DataFrame, rows: DataFrame, shape: tuple[int, int], judge: Callable, schema: str) -> DataFrame:
    """``judge(anchors, rows)`` for every block of anchors with every block of rows."""
    n_anchors, n_rows = shape

    def up_to(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = anchors.withColumn("a", F.pmod(F.xxhash64("id"), F.lit(n_anchors)).cast("int")).withColumn("r", up_to(n_rows))
    right = rows.withColumn("r", F.pmod("row", F.lit(n_rows)).cast("int")).withColumn("a", up_to(n_anchors))
    return left.groupBy("a", "r").cogroup(right.groupBy("a", "r")).applyInArrow(judge, schema)


def hard_negatives(
    rows: DataFrame,
    anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vector: str = "embedding",
    label: str | Column = "label",
) -> DataFrame:
    """For each anchor and positive the best negatives: (anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score).

    Anchors are the rows where ``anchor`` holds. Each component x counts as floor(scale * x). An anchor's positives are
    the best other rows of its label; negatives are the best rows of other labels with a score of ``low`` to ``high``
    percent of the positive's. Equal scores go by the smaller id, null last.

    All anchors meet all rows, block by block, twice: for the positives, then for the negatives between the bounds
    that the positives give. A block hands on its best few for each anchor, so what is shuffled after the products
    grows with anchors and blocks, not with pairs; the rows before them go to each block of anchors.

    Rows with a null label or vector, or with a null, NaN or infinite component, take no part. Shorter vectors count
    as filled up with zeros. Rows that share an id are all candidates, for other ids than their own; as an anchor
    an id counts once, with its least label and vector. A null id is never an anchor. Without anchors, or without
    candidates, there are no rows. Scores beyond 2**51 raise an error. Other columns are not read.
    """
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    own = F.col(f"`{label}`") if isinstance(label, str) else label
    scaled = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    whole = rows.where(finite & own.isNotNull()).select(
        F.col(f"`{id_col}`").alias("id"),
        own.alias("label"),
        scaled.alias("v"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.monotonically_increasing_id().alias("row"),
    )
    whole = written(whole, "vectors")
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    facts = whole.agg(
        F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(length).alias("most"), F.count_if("anchor").alias("anchors")
    ).first()
    spark = rows.sparkSession
    if not facts["anchors"]:
        return spark.createDataFrame([], RESULT)
    if facts["most"] * 1.001 > MOST:
        raise OverflowError(f"inner products reach {facts['most']:.3g}; scale the vectors down")
    width, n_rows, n_anchors = facts["width"], facts["n"], facts["anchors"]
    primes = primes_for(int(facts["most"] * 1.001) + 1, width)  # no product is larger than the longest vector's with itself
    block = max(1, min(ROW_BLOCK, BLOCK_VALUES // max(width, 1)))
    shape = -(-n_anchors // min(ANCHOR_BLOCK, block)), -(-n_rows // block)

    least = F.min(F.struct("label", "v")).alias("x")
    anchors = whole.where("anchor and id is not null").groupBy("id").agg(least).select("id", "x.label", "x.v")
    anchors = written(anchors, "anchors")

    def positives_of(a: pa.Table, b: pa.Table) -> pa.Table:
        found = [np.zeros((3, 0), np.int64)]
        if len(a) and len(b):
            cell = Cell(a, b, width, primes)
            names = a["id"].to_numpy()
            for some, score, same in cell.stripes():
                other = (names[some, None] != cell.ids[None, :]) | ~cell.known
                i, j = best_of_rows(score, same & other, positives)
                found.append(np.stack([names[some][i], np.where(cell.known[j], cell.ids[j], _LEAST), score[i, j]]))
        return _table(np.hstack(found), ["anchor_id", "id", "score"], "id")

    best = _in_cells(anchors, whole, shape, positives_of, "anchor_id long, id long, score long")
    by_score = [F.desc("score"), F.asc_nulls_last("id")]
    chosen = written(first_rows_per_key(best, ["anchor_id"], by_score, positives, "place"), "positives")

    scores = F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda x: x["score"]).alias("scores")
    ready = written(anchors.join(chosen.groupBy(F.col("anchor_id").alias("id")).agg(scores), "id"), "anchor-scores")

    def negatives_of(a: pa.Table, b: pa.Table) -> pa.Table:
        found = [np.zeros((4, 0), np.int64)]
        if len(a) and len(b):
            cell = Cell(a, b, width, primes)
            names, many = a["id"].to_numpy(), a["scores"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
            aims = _matrix(a["scores"], positives)
            lows, highs = -(-low * aims // 100), high * aims // 100
            for some, score, same in cell.stripes():
                for place in range(positives):
                    there = (many[some] > place)[:, None] & ~same
                    between = (score >= lows[some, place, None]) & (score <= highs[some, place, None])
                    i, j = best_of_rows(score, there & between, negatives)
                    known = np.where(cell.known[j], cell.ids[j], _LEAST)
                    found.append(np.stack([names[some][i], np.full(len(i), place + 1), known, score[i, j]]))
        return _table(np.hstack(found), ["anchor_id", "place", "id", "score"], "id")

    near = _in_cells(ready, whole, shape, negatives_of, "anchor_id long, place long, id long, score long")
    ranked = first_rows_per_key(near, ["anchor_id", "place"], by_score, negatives, "rank")
    found = chosen.select("anchor_id", F.col("place").cast("long").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return ranked.join(found, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def _table(columns: np.ndarray, names: list[str], nullable: str) -> pa.Table:
    return pa.table({n: pa.array(c, mask=(c == _LEAST) if n == nullable else None) for n, c in zip(names, columns, strict=True)})


shipped(__name__)
