"""Toxicity by a classifier chain: linear models in turn, each fed with the probabilities of those before."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import kept_text, shipped, written

#: Labelled rows that the linear models are fitted on, at most, drawn by a hash.
SAMPLE = 10_000
#: Words of each category that the models look at, and in how many labelled texts a word must occur.
VOCABULARY = 1024
MIN_TEXTS = 5
#: Squared standard deviations from chance that a word must be: with a million words, chance brings one such.
MIN_TELL = 25.0
#: Standard deviations from chance by which the hits of a threshold must lead, or the category is never called.
MIN_LEAD = 4.0
FOLDS = 4
RIDGE = 1e-3
STEPS = 120
_WORD = re.compile(r"[^\W\d_]+")
WORD_PATTERN = r"[\p{L}]+"


@dataclass
class Chain:
    """``weights[i]`` belongs to category i: one per word, one per earlier category, and a constant."""

    categories: list[str]
    words: dict[str, int]
    weights: list[np.ndarray] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Sparse:
    """Rows of a 0/1 matrix, given by the columns that hold 1; further dense columns on the right."""

    def __init__(self, rows: list[np.ndarray], width: int, dense: np.ndarray):
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.column = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
        self.n, self.width, self.dense = len(rows), width, dense

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.column], minlength=self.n) + self.dense @ w[self.width :]

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.column, weights=g[self.row], minlength=self.width), self.dense.T @ g])


def _fitted(x: Sparse, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a ridge penalty, by gradient descent with momentum and scaled steps."""
    w = np.zeros(x.width + x.dense.shape[1])
    rate = max(min(float(y.mean()), 1 - 1e-6), 1e-6) if len(y) else 0.5
    w[-1] = np.log(rate / (1 - rate))
    scale = x.back(np.ones(x.n))[: x.width] / max(x.n, 1)
    step = 1 / (np.concatenate([scale, (x.dense**2).mean(axis=0) if x.n else np.ones(x.dense.shape[1])]) * 8 + RIDGE)
    speed = np.zeros_like(w)
    for _ in range(STEPS):
        ahead = w + 0.9 * speed
        slope = x.back(_sigmoid(x.dot(ahead)) - y) / max(x.n, 1) + RIDGE * np.r_[ahead[:-1], 0]
        speed = 0.9 * speed - 0.1 * step * slope
        w = w + speed
    return w


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Where out-of-fold probabilities give the best F1; 1 and more (never) if there is no positive row, or if the rows
    called there are positive no more often than all rows are, beyond chance."""
    if not y.any():
        return 2.0
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    ends = np.r_[p[order][1:] != p[order][:-1], True]  # a cut between equal probabilities is none
    best = int(np.argmax(np.where(ends, f1, -1)))
    n, rate = best + 1, float(y.mean())
    if hits[best] - n * rate < MIN_LEAD * np.sqrt(n * rate * (1 - rate)) or n == len(y) > y.sum():
        return 2.0
    below = p[order][best + 1] if best + 1 < len(p) else 0.0
    return float((p[order][best] + below) / 2)


def fit_chain(rows: list[np.ndarray], labels: np.ndarray, folds: np.ndarray, categories: list[str], words: dict[str, int]) -> Chain:
    """Fits the categories in order. What a category passes on to later ones is predicted by models that were
    fitted without the row's fold, as the rows to be judged will not have been fitted on either."""
    chain = Chain(categories, words)
    earlier = np.zeros((len(rows), 0))
    for c in range(len(categories)):
        dense = np.hstack([earlier, np.ones((len(rows), 1))])
        y = labels[:, c].astype(float)
        out_of_fold = np.zeros(len(rows))
        for f in range(FOLDS):
            rest, held = np.flatnonzero(folds != f), np.flatnonzero(folds == f)
            w = _fitted(Sparse([rows[i] for i in rest], len(words), dense[rest]), y[rest])
            out_of_fold[held] = _sigmoid(Sparse([rows[i] for i in held], len(words), dense[held]).dot(w))
        chain.weights.append(_fitted(Sparse(rows, len(words), dense), y))
        chain.thresholds.append(_threshold(out_of_fold, y))
        earlier = np.hstack([earlier, out_of_fold[:, None]])
    return chain


def _word_sets(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0)))


def learn(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text: str = "text") -> Chain:
    """A chain for the 0/1 columns ``categories`` of ``labels``, fitted in that order.

    ``labels`` meet the documents by ``id_col``; rows with a null label or id are left out, repeated rows count
    as often as they meet. For each category the VOCABULARY words are chosen whose presence tells most about it, the
    first by name of equal ones, counted over all labelled documents. What is shuffled for that is the distinct
    words of each document, not its text, and by the same plan at every size. The models are fitted on the documents
    of SAMPLE label rows at most, drawn from those that meet a document, the only ones that are broadcast; with
    VOCABULARY that bounds what comes to the driver. A category that nothing tells is never called.
    """
    y = [f"y{i}" for i in range(len(categories))]
    marks = labels.select(
        F.col(f"`{id_col}`").alias("id"), *(F.col(f"`{c}`").cast("int").alias(n) for c, n in zip(categories, y, strict=True))
    ).dropna()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), kept_text(f"`{text}`").alias("text"))
    # the empty word stands in every document, so its counts are those of all documents
    words = F.array_join(F.concat(F.array(F.lit("")), _word_sets(F.col("text"))), " ").alias("words")
    labelled = rows.where("id is not null").select("id", words).hint("merge").join(marks, "id")
    sums = [F.sum(n).alias(f"k{i}") for i, n in enumerate(y)]
    counts = labelled.select(F.explode(F.split("words", " ")).alias("w"), *y).groupBy("w").agg(F.count("*").alias("n"), *sums)
    counts = written(counts.where((F.col("n") >= MIN_TEXTS) | (F.col("w") == "")), "word-counts")
    total = counts.where("w = ''").first()
    if not total:
        return Chain(categories, {}, [np.zeros(i + 1) for i in range(len(categories))], [2.0] * len(categories))

    def told(i: int) -> Column:
        """How far the word's positive texts are from chance, in standard deviations, squared."""
        rate = min(max(total[f"k{i}"] / total["n"], 1e-9), 1 - 1e-9)
        return F.pow(F.col(f"k{i}") - F.col("n") * rate, F.lit(2)) / (F.col("n") * rate * (1 - rate))

    able = counts.where(f"w <> '' and n >= {MIN_TEXTS}")
    ranked = [able.select("w", told(i).alias("tells")).where(F.col("tells") >= MIN_TELL) for i in range(len(categories))]
    chosen = [r for telling in ranked for r in telling.orderBy(F.desc("tells"), "w").limit(VOCABULARY).select("w").collect()]
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(r["w"] for r in chosen))}
    held = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(_columns(t, held.value)) for t in batch.column("text").to_pylist()]
            names = [n for n in batch.schema.names if n != "text"]
            columns = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.list_(pa.int32()))], [*names, "at"])

    met = marks.join(rows.select("id"), "id", "left_semi")
    drawn = F.broadcast(met.orderBy(F.xxhash64("id", *y), "id", *y).limit(SAMPLE))
    sample = rows.join(drawn, "id").select(F.xxhash64("id", "text").alias("h"), F.col("id").cast("string").alias("id"), "text", *y)
    kinds = ", ".join(f"{n} int" for n in y)
    sample = sample.select("h", "id", *y, "text").mapInArrow(looked_up, f"h long, id string, {kinds}, at array<int>")
    got = sample.orderBy("h", "id", *y).limit(SAMPLE).toPandas().sort_values(["id", "h", *y], kind="stable")
    at = [np.asarray(a, np.int64) for a in got["at"]]
    folds = np.arange(len(got)) % FOLDS
    return fit_chain(at, got[y].to_numpy(), folds, categories, vocabulary)


def _columns(text: str, words: dict[str, int]) -> set[int]:
    return {words[w] for w in words.keys() & set(_WORD.findall(text.lower()))}


def predict(docs: DataFrame, chain: Chain, carried: list[str] | None = None, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the ``carried`` columns (``doc_id`` unless given) and for each category its
    probability ``p_<category>`` and ``<category>``, whether that reaches the threshold.

    The presence of the chain's words in the whole text is what counts. A null or empty text has none of them
    and gets the constants' probabilities, but no category. Rows are judged one by one; columns that are not
    carried are not read. A chain that was fitted without labelled rows finds nothing.
    """
    carried = ["doc_id"] if carried is None else carried
    rows = docs.select(*(F.col(f"`{c}`") for c in carried), kept_text(f"`{text}`").alias("__text"))
    held = docs.sparkSession.sparkContext.broadcast(vars(chain))

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Chain(**held.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            at = [np.fromiter(_columns(t, chain.words), np.int64) for t in texts]
            some = np.array([bool(t) for t in texts], bool)
            dense = np.ones((len(texts), 1))
            columns, names = [batch.column(i) for i in range(batch.num_columns - 1)], list(batch.schema.names[:-1])
            for name, w, least in zip(chain.categories, chain.weights, chain.thresholds, strict=True):
                p = _sigmoid(Sparse(at, len(chain.words), dense).dot(w))
                columns += [pa.array(p), pa.array((p >= least) & some)]
                names += [f"p_{name}", name]
                dense = np.hstack([dense[:, :-1], p[:, None], dense[:, -1:]])
            yield pa.RecordBatch.from_arrays(columns, names)

    kinds = dict(rows.dtypes)
    found = [f"p_{c} double, {c} boolean" for c in chain.categories]
    return rows.mapInArrow(predicted, ", ".join([*(f"`{c}` {kinds[c]}" for c in carried), *found]))


shipped(__name__)
