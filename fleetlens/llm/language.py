"""Language of each word and span: script ranges, letter-triple scores, and Viterbi with a switching penalty."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import kept_text, shipped

#: Triples of letters are counted in so many slots.
SLOTS = 1 << 16
#: Log-probability that a change of language between two words costs.
SWITCH = 12.0
#: Added to every count.
SMOOTHING = 0.5
#: A language is a candidate for a script that holds at least this share of its letters.
SCRIPT_SHARE = 0.01
#: Documents are decoded together up to so many letters.
PIECE_CHARS = 1 << 20
UNKNOWN = "und"
#: First and last code point of the main letter blocks, by script. Other letters count as script 0.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
}
N_SCRIPTS = len(SCRIPTS) + 1


@dataclass
class Model:
    """``scores[slot, language]`` are log-probabilities; ``allowed[script, language]`` are 0 or a refusal."""

    languages: list[str]
    scores: np.ndarray
    allowed: np.ndarray


class Letters:
    """Which code points are letters, and of what script; made once by each task."""

    table: np.ndarray | None = None

    @classmethod
    def of(cls, codes: np.ndarray) -> np.ndarray:
        """-1 for what is no letter, else the number of the script."""
        if cls.table is None:
            table = np.full(0x110000, -1, np.int8)
            bound = 0x33480  # no letters beyond
            table[:bound] = [0 if chr(c).isalpha() else -1 for c in range(bound)]
            for number, blocks in enumerate(SCRIPTS.values(), 1):
                for low, high in blocks:
                    table[low : high + 1][table[low : high + 1] == 0] = number
            cls.table = table
        return cls.table[codes]


@dataclass
class Words:
    """The words of some documents: bounds in letters, document and script of each; slots of all triples."""

    doc: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    script: np.ndarray
    slots: np.ndarray


def _words(texts: list[str]) -> Words:
    """Runs of letters in lower case; a triple reaches over the ends of its word to the gap on either side."""
    codes = np.frombuffer(("\n" + "\n".join(texts) + "\n").lower().encode("utf-32-le", "replace"), np.uint32)
    script = Letters.of(codes)
    letter = script >= 0
    breaks = np.cumsum([0, *(len(t.lower()) + 1 for t in texts)])
    starts = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    ends = np.flatnonzero(~letter[1:] & letter[:-1]) + 1
    plain = np.where(letter, codes, 0).astype(np.uint32)
    slots = np.zeros(len(codes), np.uint32)
    mixed = plain[:-2] * np.uint32(0x9E3779B1) ^ (plain[1:-1] * np.uint32(0x85EBCA77)) ^ (plain[2:] * np.uint32(0xC2B2AE3D))
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    slots[1:-1] = mixed >> np.uint32(16)
    return Words(np.searchsorted(breaks, starts, "right") - 1, starts, ends, script[starts], slots)


def _grouped(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > PIECE_CHARS:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if texts:
        yield first, texts[first:]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language, how often each slot and script occurs among the letters of a partition."""
    slots: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for batch in batches:
        names = np.array(batch.column("lang").to_pylist(), object)
        for first, texts in _grouped(batch.column("text").to_pylist()):
            w = _words(texts)
            lengths = w.ends - w.starts
            inside = np.repeat(w.starts - np.cumsum([0, *lengths[:-1]]), lengths) + np.arange(lengths.sum())
            owner = np.repeat(names[first + w.doc], lengths) if len(w.doc) else np.zeros(0, object)
            by_word = names[first + w.doc] if len(w.doc) else owner
            for name in set(by_word):
                slots.setdefault(name, np.zeros(SLOTS, np.int64))
                scripts.setdefault(name, np.zeros(N_SCRIPTS, np.int64))
                slots[name] += np.bincount(w.slots[inside[owner == name]], minlength=SLOTS)
                mine = by_word == name
                scripts[name] += np.bincount(w.script[mine], weights=lengths[mine], minlength=N_SCRIPTS).astype(np.int64)
    for name, counts in slots.items():
        both = np.concatenate([counts, scripts[name]])
        at = np.flatnonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(both[at])], ["lang", "at", "n"])


def learn(labelled: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """A model of all rows with a language and a text.

    What comes to the driver is one row per language and slot: at most SLOTS + N_SCRIPTS for each language,
    whatever the data. Without labelled rows the model knows no language.
    """
    rows = labelled.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"))
    rows = rows.where("lang is not null and text is not null").mapInArrow(_counted, "lang string, at long, n long")
    counts = rows.groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    all_counts = np.zeros((SLOTS + N_SCRIPTS, len(languages)))
    all_counts[counts["at"], counts["lang"].map({x: i for i, x in enumerate(languages)})] = counts["n"]
    triples, scripts = all_counts[:SLOTS] + SMOOTHING, all_counts[SLOTS:]
    scores = np.log(triples / triples.sum(axis=0, keepdims=True))
    share = scripts / np.maximum(scripts.sum(axis=0, keepdims=True), 1)
    allowed = np.where(share >= SCRIPT_SHARE, 0.0, -1e3)
    return Model(languages, scores.astype(np.float32), allowed.astype(np.float32))


def _best_paths(scores: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The language of each word, by Viterbi over the words of each document, all documents in step.

    Documents are sorted by length, so that those that still have words are the first ones.
    """
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = bounds[:-1][order], lengths[order]
    n_lang = scores.shape[1]
    path = np.zeros(len(scores), np.int8 if n_lang < 128 else np.int32)
    if not len(scores):
        return path
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # documents with more than t words
    stay = np.ones((len(scores), n_lang), bool)
    came = np.zeros(len(scores), path.dtype)
    best = scores[starts[: active[0]]].copy()
    for t in range(1, lengths[0]):
        n = active[t]
        at = starts[:n] + t
        now = best[:n]
        top = now.argmax(axis=1)
        other = now[np.arange(n), top][:, None] - SWITCH
        kept = now >= other
        stay[at], came[at] = kept, top
        best[:n] = np.where(kept, now, other) + scores[at]
    last = best.argmax(axis=1)
    state = last.astype(path.dtype)
    for t in range(lengths[0] - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        path[at] = state[:n]
        state[:n] = np.where(stay[at, state[:n]], state[:n], came[at])
    return path


def _labelled(texts: list[str], model: Model) -> Iterator[tuple[str, float, list[dict]]]:
    """(language, share of the letters, spans) of each text; spans are in words."""
    w = _words(texts)
    lengths = w.ends - w.starts
    bounds = np.searchsorted(w.doc, np.arange(len(texts) + 1))
    if len(w.doc):
        sums = np.zeros((len(w.slots) + 1, len(model.languages)))
        np.cumsum(model.scores[w.slots], axis=0, dtype=np.float64, out=sums[1:])
        scores = sums[w.ends] - sums[w.starts] + model.allowed[w.script]
    else:
        scores = np.zeros((0, len(model.languages)))
    path = _best_paths(scores, bounds)
    for d in range(len(texts)):
        a, b = bounds[d], bounds[d + 1]
        if a == b:
            yield UNKNOWN, 0.0, []
            continue
        own = path[a:b]
        shares = np.bincount(own, weights=lengths[a:b], minlength=len(model.languages))
        top = int(shares.argmax())
        cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
        firsts, lasts = [0, *cuts.tolist()], [*cuts.tolist(), b - a]
        spans = [{"first_word": f, "end_word": e, "lang": model.languages[own[f]]} for f, e in zip(firsts, lasts, strict=True)]
        yield model.languages[top], float(shares[top] / shares.sum()), spans


SPANS = "array<struct<first_word:int,end_word:int,lang:string>>"
_SPAN_TYPE = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("lang", pa.string())]))


def identify(docs: DataFrame, model: Model, carried: list[str] | None = None, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the ``carried`` columns (``doc_id`` unless given), lang_pred, score, spans.

    A word is a run of letters. It scores the log-probabilities of its letter triples; languages that hardly use
    its script are refused. Viterbi finds the best labels of all words of a text when each change of language
    costs SWITCH. ``lang_pred`` is the language with most letters, ``score`` its share of them; ``spans`` are the
    runs of words of one language. Ties go to the first language by name.

    A null text, one without letters, and any text if the model knows no language, give ``und``, 0 and no
    spans. Rows are judged one by one, so repeated rows agree. Columns that are not carried are not read.
    """
    carried = ["doc_id"] if carried is None else carried
    rows = docs.select(*(F.col(f"`{c}`") for c in carried), kept_text(f"`{text}`").alias("__text"))
    held = docs.sparkSession.sparkContext.broadcast(vars(model))

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**held.value)
        for batch in batches:
            column = batch.column(batch.num_columns - 1).to_pylist()
            for first, texts in _grouped(column):
                found = list(_labelled(texts, model)) if model.languages else [(UNKNOWN, 0.0, [])] * len(texts)
                names, scores, spans = zip(*found, strict=True)
                kept = [batch.column(i).slice(first, len(texts)) for i in range(batch.num_columns - 1)]
                columns = [*kept, pa.array(names), pa.array(scores), pa.array(spans, _SPAN_TYPE)]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "lang_pred", "score", "spans"])

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carried), "lang_pred string, score double", f"spans {SPANS}"])
    return rows.mapInArrow(predicted, schema)


shipped(__name__)
