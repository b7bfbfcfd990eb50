"""Importance resampling against a plain count of every word run."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from fleetlens.llm import importance
from fleetlens.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, n_words string, doc string, row long, part int, score string"


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def features_of(text):
    w = words_of(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute_force(docs, target, min_words=20):
    def buckets(texts):
        return Counter(zlib.crc32(f.encode()) % 10000 for t in texts for f in features_of(t))

    s, t = buckets(x for _, x in docs), buckets(target)
    total, wanted = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (total + 10000) / ((s[b] + 1) * (wanted + 10000))))

    rows = []
    for i, text in docs:
        found = features_of(text)
        weight = sum(gain(zlib.crc32(f.encode()) % 10000) for f in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(found), weight, score, len(words_of(text))])
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[: 5 * len(able) // 100]
    ranks = {id(r): k for k, r in enumerate(drawn, 1)}
    return [(*r[:4], ranks.get(id(r))) for r in rows]


def by_value(rows):
    return sorted(rows, key=lambda r: [(x is None, x or 0) for x in r])


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    found = [tuple(r) for r in QUERIES["op11_importance"](spark, DATA).collect()]
    assert by_value(found) == by_value(brute_force(docs, target))
    assert sum(r[4] is not None for r in found) > 3


def test_odd_rows_and_clashing_names(spark):
    long = " ".join(f"Wort{i}é" for i in range(30))
    texts = [None, "", " \t!", "ab-CD Ef", "日本語 text " * 15, "x" * 300 + " " + "y" * 70, long, long, "KK É"]
    docs = [(i if i % 4 else None, t) for i, t in enumerate(texts * 7)]
    rows = spark.createDataFrame([(i, t, "a", "b", 1, 2, "c") for i, t in docs], COLUMNS)
    target = spark.createDataFrame([(long, 1), (None, 2)], "text string, doc_id long")
    found = importance.resampled(rows, target).select("doc.*", "weight", "n_features", "rank", "score")
    got = importance.resampled(rows, target).collect()
    want = brute_force(docs, [long, None])
    assert by_value((r.doc.doc_id, r.n_features, r.weight, r.score) for r in got) == by_value(w[:4] for w in want)
    # repeated rows are alike, so only the ranks that are given are fixed
    assert sorted((r.rank, r.score, r.doc.doc_id) for r in got if r.rank) == sorted((w[4], w[3], w[0]) for w in want if w[4])
    assert found.columns[:7] == rows.columns and found.count() == len(docs)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 10)], "doc_id long, text string")
    assert importance.resampled(docs, some).count() == 0
    assert [r.rank for r in importance.resampled(some, docs).collect()] == [None]


def test_ties_are_drawn_by_id_over_many_partitions(spark):
    rows = spark.createDataFrame([(1, "one two three four " * 6)] * 300 + [(2, "one two three four " * 6)] * 300, "doc_id long, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = importance.resampled(rows.repartition(9), rows, percent=60).where("rank is not null").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert sorted(r.rank for r in got) == list(range(1, 361))
    first = max((r.score, -r.doc.doc_id) for r in got)[1]
    assert all((r.doc.doc_id == -first) == (r.rank <= 300) for r in got)


@pytest.mark.parametrize("piece", [7, 64, 1 << 20])
def test_pieces_of_long_texts(monkeypatch, piece):
    monkeypatch.setattr(importance, "PIECE_BYTES", piece)
    texts = [b"a b c d e f g h i j k", b"", b"x" * 200 + b" y z", b"one two", b" ", b"three"]
    words, found = importance.Words(), Counter()
    for _, some in importance.features(texts, words):
        for doc, bucket in some:
            found.update(zip(doc.tolist(), bucket.tolist(), strict=True))
    assert found == Counter((i, zlib.crc32(f.encode()) % 10000) for i, t in enumerate(texts) for f in features_of(t.decode()))


def test_shifted_checksums():
    a, b = [b"", b"a", b"hello"], [b"", b" b" * 100, b"x" * 63, b"y" * 64, b"z" * 4097]
    for x in a:
        crc = np.array([zlib.crc32(x)] * len(b), np.uint32)
        got = importance.shifted(crc, np.array([len(y) for y in b])) ^ np.array([zlib.crc32(y) for y in b], np.uint32)
        assert got.tolist() == [zlib.crc32(x + y) for y in b]


def test_forgotten_words_change_nothing(monkeypatch):
    texts = [b"a b c a b c d", b"b c d e", b"a e f g a"]

    def counted():
        words = importance.Words()
        return [(d.tolist(), b.tolist()) for t in texts for _, some in importance.features([t], words) for d, b in some]

    want = counted()
    monkeypatch.setattr(importance, "REMEMBERED", 1)
    assert counted() == want
