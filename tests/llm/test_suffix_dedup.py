"""Repeated strings against every window, all copies and all but the first, and the arrays against plain search."""

from __future__ import annotations

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import queries, suffix_dedup

DATA = "/root/testdata/sf0.001"
N = suffix_dedup.LENGTH


def planted():
    """Passages that texts share in parts, within a text and across, with null and repeated ids and equal rows."""
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdé ") for _ in range(900))
    noise = ["".join(rng.choice("uvwxyz ") for _ in range(150)) for _ in range(40)]
    rows = [(i, noise[i] + passage[rng.randrange(0, 300) : rng.randrange(500, 900)] + noise[i + 1]) for i in range(20)]
    rows += [(30, passage + noise[30] + passage[200:800]), (30, noise[31] * 4), (31, noise[31] * 4), (None, passage), (None, passage), (None, noise[32] * 3)]
    rows += [(32, "a" * 1500), (33, "a" * 405), (34, None), (35, ""), (36, passage[:200]), (7, passage[100:600]), (7, passage[100:600])]
    return rows


def expected(keyed, keep_first):
    """``keyed`` has (id, text key, bytes): the removed bytes of each by comparing all windows."""
    starts = {}
    for i, k, b in keyed:
        for p in range(len(b) - N + 1):
            starts.setdefault(b[p : p + N], []).append(((i is not None, i or 0, k), p))
    first = {w: min(v) for w, v in starts.items()}
    found = []
    for i, k, b in keyed:
        cover = np.zeros(len(b), bool)
        for p in range(len(b) - N + 1):
            w = b[p : p + N]
            if first[w] != ((i is not None, i or 0, k), p) if keep_first else len(starts[w]) > 1:
                cover[p : p + N] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~cover])
        spans = int((np.diff(np.r_[0, cover.astype(int)]) == 1).sum())
        found.append((str(i), len(b), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(found)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.unionByName(spark.read.parquet(f"{DATA}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("k"), F.coalesce("text", F.lit("")).alias("t")).collect()
    return docs, [(r["doc_id"], r["k"], r["t"].encode()) for r in keyed]


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("group, hot_share", [(256, 1000), (2, 10**9)])
def test_both_modes_against_every_window(corpus, monkeypatch, keep_first, group, hot_share):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "HOT_SHARE", hot_share)
    docs, keyed = corpus
    got = suffix_dedup.repeated_spans(docs, keep_first=keep_first).collect()
    found = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in got)
    assert found == expected(keyed, keep_first)


def test_a_third_of_equal_rows(spark):
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefgh ") for _ in range(700))
    rows = [(None, text)] * 400 + [(i, f"{i:07d}" * 70) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    every = suffix_dedup.repeated_spans(docs).where("doc_id is null").select("n_removed").collect()
    assert [r["n_removed"] for r in every] == [700] * 400
    first = suffix_dedup.repeated_spans(docs, keep_first=True).where("doc_id is null").select("n_removed").collect()
    assert [r["n_removed"] for r in first] == [0] * 400


def test_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    for keep_first in (False, True):
        assert suffix_dedup.repeated_spans(docs, keep_first=keep_first).collect() == []


def test_longest_factors_against_plain_search():
    rng = random.Random(3)

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    for _ in range(200):
        text = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 40)))
        order = sorted(range(len(text)), key=lambda i: text[i:])
        lcp = np.array([0, *(common(text[i:], text[j:]) for i, j in zip(order, order[1:], strict=False))])
        got = suffix_dedup.longest_factors(np.array(order), lcp, 1)
        plain = [max((common(text[i:], text[j:]) for j in range(i)), default=0) for i in order]
        assert got.tolist() == plain


def test_runs_of_windows_against_all_pairs(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LENGTH", 6)
    rng = random.Random(4)
    for _ in range(150):
        contexts, groups = [], []
        for _ in range(rng.randrange(1, 14)):
            low = rng.randrange(0, 4)
            high = low + rng.randrange(0, 4)
            contexts.append((bytes(rng.choice(b"ab") for _ in range(high)), bytes(rng.choice(b"ab") for _ in range(6 - low)), low, high))
            groups.append(rng.randrange(2))

        def windows(i):
            left, right, low, high = contexts[i]
            return {(groups[i], a, (left[len(left) - a :] + right)[:6]) for a in range(low, high + 1)}

        for only_later in (False, True):
            got = suffix_dedup.repeated_offsets(contexts, groups, only_later)
            for i, runs in enumerate(got):
                others = [windows(j) for j in range(len(contexts)) if j < i or (j > i and not only_later)]
                plain = {a for g, a, w in windows(i) if any((g, a, w) in o for o in others)}
                assert {a for first, last in runs for a in range(first, last + 1)} == plain


def test_contexts_are_sent_in_batches_of_bounded_size(monkeypatch):
    """One batch of the input makes many times its bytes; a task must not hold them together."""
    monkeypatch.setattr(suffix_dedup, "SENT_ROWS", 64)
    rng = random.Random(7)
    texts = [rng.randbytes(900).hex() for _ in range(700)]
    place = {"g": 1, "s": 0, "n": 1, "x": 255, "low": 0, "high": 255}
    places = [[{**place, "s": i}, {**place, "s": -i, "x": 500, "low": 400, "high": 500}] for i in range(len(texts))]
    docs = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text_key": [3] * len(texts), "text": texts, "places": places})
    contexts = list(suffix_dedup._context_rows(iter([docs])))
    assert max(b.nbytes for b in contexts) < 1 << 16
    rows = [r for b in contexts for r in b.to_pylist()]
    assert [(r["id"], r["s"], (r["left"] + r["right"]).decode()) for r in rows] == [
        (i, p["s"], texts[i][p["low"] : p["high"] + N]) for i in range(len(texts)) for p in places[i]
    ]

    whole = pa.RecordBatch.from_pylist(rows, contexts[0].schema)
    for cell in suffix_dedup.CELLS:
        parts = list(suffix_dedup._parted(cell)(iter([whole.slice(0, 40)])))
        assert max(b.nbytes for b in parts) < (1 << 16 if cell > 1 else 1 << 13)
        windows = [(r["id"], r["at"], a) for b in parts for r in b.to_pylist() for a in range(r["a_low"], r["a_high"] + 1)]
        assert sorted(windows) == sorted((r["id"], r["at"], a) for r in rows[:40] for a in range(r["a_low"], r["a_high"] + 1))


def test_what_a_worker_holds_does_not_grow_with_the_batch():
    """Anchors are searched and texts cleaned a few at a time, so that a worker holds a part of its batch."""
    rng = random.Random(9)
    texts = [rng.randbytes(1500).hex() for _ in range(1200)]
    runs = [[{"first": 100 + i, "last": 200 + i}, {"first": 300, "last": 400 + i}] for i in range(len(texts))]
    columns = {"id": list(range(len(texts))), "n_bytes": [3000] * len(texts), "text_key": [3] * len(texts), "text": texts, "runs": runs}
    docs = pa.RecordBatch.from_pydict({**columns, "copies": [1] * len(texts)})

    singly = [r for i in range(0, len(texts), 100) for b in suffix_dedup._anchor_rows(iter([docs.slice(i, 1)])) for r in b.to_pylist()]
    tracemalloc.start()
    together = list(suffix_dedup._anchor_rows(iter([docs])))
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 32 << 20
    assert [r for b in together for r in b.to_pylist() if r["id"] % 100 == 0] == singly

    cleaned = list(suffix_dedup._cleaned(iter([docs])))
    assert max(b.num_rows for b in cleaned) <= suffix_dedup.SLICE
    got = [r for b in cleaned for r in b.to_pylist()]
    assert [r["id"] for r in got] == list(range(len(texts)))
    for i in (0, 300, 1199):
        edges = [(100 + i, 200 + i + N), (300, 400 + i + N)]
        kept = "".join(c for p, c in enumerate(texts[i]) if not any(a <= p < b for a, b in edges))
        assert (got[i]["n_removed"], got[i]["kept_sha256"]) == (3000 - len(kept), hashlib.sha256(kept.encode()).hexdigest())


def test_passages_of_over_fifty_words_by_their_bytes(spark, tmp_path):
    """A passage counts from LENGTH bytes on, however many words it has; other documents are left alone."""
    rng = random.Random(8)

    def words(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 7))) for _ in range(400))[: n - 1] + "."

    passages = [words(n) for n in (N - 60, N - 1, N, N + 1, N + 300)]
    assert all(len(p.split()) > 50 for p in passages)
    rows = [(10 * k + i, f"{words(700)}{i}{p}{i}{words(500)}") for k, p in enumerate(passages) for i in range(4)]
    rows += [(100 + i, words(1500)) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op1_suffix_dedup(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        passage = passages[doc_id // 10] if doc_id < 100 else ""
        kept = text.replace(passage, "") if len(passage) >= N else text
        removed = len(text) - len(kept)
        r = got[doc_id]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["has_repeats"]) == (len(text), removed, int(removed > 0), removed > 0)
        assert r["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
