"""Importance resampling: documents drawn so that their hashed word runs come near those of a target."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import kept_text, shipped, written
from fleetlens.llm.textbytes import PIECE_BYTES

BUCKETS = 10_000
#: Longest run of words that is a feature.
RUN = 3
#: Share of the documents with MIN_WORDS words or more that is drawn, in percent.
PERCENT = 5
MIN_WORDS = 20
SEED = 42
#: Words whose checksums a worker remembers; beyond that it forgets all and goes on.
REMEMBERED = 400_000
SHORT = 64

#: Between texts, and no byte of a word.
SENTINEL = b"\x00"
# Words are runs of 0-9, a-z and everything beyond ASCII: in UTF-8 every byte of those is 0x80 or more.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
_IS_WORD = np.array([bool(_WORD.fullmatch(bytes([b]))) for b in range(256)])
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_POLYNOMIAL = 0xEDB88320


def _after_zero_byte(crc: np.ndarray) -> np.ndarray:
    """A checksum's part in the checksum of a text that is a byte longer."""
    for _ in range(8):
        crc = (crc >> np.uint32(1)) ^ np.where(crc & np.uint32(1), np.uint32(_POLYNOMIAL), np.uint32(0))
    return crc


def _shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """For 0 to SHORT - 1 bytes, and for powers of two: what each byte of a checksum becomes, four times 256 values."""
    steps = [np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])]
    for _ in range(SHORT - 1):
        steps.append(_after_zero_byte(steps[-1]))
    powers = [steps[1]]
    for _ in range(40):
        powers.append(_looked_up(powers[-1], powers[-1], np.int64(0)))
    return np.concatenate(steps), np.stack(powers)


def _looked_up(table: np.ndarray, crc: np.ndarray, base: np.ndarray | np.int64) -> np.ndarray:
    out = np.zeros(len(crc), np.uint32)
    for k in range(4):
        out ^= table[base + 256 * k + ((crc >> np.uint32(8 * k)) & np.uint32(255)).astype(np.int64)]
    return out


_SHORT_STEPS, _POWERS = _shift_tables()


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """``crc32(a + b) == shifted(crc32(a), len(b)) ^ crc32(b)``, for arrays."""
    out = _looked_up(_SHORT_STEPS, crc, np.minimum(n_bytes, SHORT - 1) * 1024)
    for i in np.flatnonzero(n_bytes >= SHORT):
        one = crc[i : i + 1]
        for k in range(int(n_bytes[i]).bit_length()):
            if int(n_bytes[i]) >> k & 1:
                one = _looked_up(_POWERS[k], one, np.int64(0))
        out[i] = one[0]
    return out


class Words(dict):
    """Numbers of words, with the checksums of each alone and after a space, and its bytes with the space."""

    def __init__(self):
        super().__init__()
        self.rows: list[tuple[int, int, int]] = []
        self.table = np.zeros((0, 3), np.int64)

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.rows)
        self.rows.append((zlib.crc32(word), zlib.crc32(b" " + word), len(word) + 1))
        return number

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
            self.rows, self.table = [], np.zeros((0, 3), np.int64)
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if len(self.table) < len(self.rows):
            self.table = np.concatenate([self.table, np.array(self.rows[len(self.table) :], np.int64).reshape(-1, 3)])
        return self.table[numbers]


def _parts(texts: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """(number of the text, bytes); a long text comes in parts that end where no word is cut."""
    for i, text in enumerate(texts):
        at = 0
        while len(text) - at > PIECE_BYTES and (gap := _GAP.search(text, at + PIECE_BYTES)):
            yield i, text[at : gap.start()]
            at = gap.start()
        yield i, text[at:]


def features(texts: list[bytes], words: Words, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Piece by piece, the text number of every word, and (text number, bucket) of every run of 1 to RUN words.

    Texts are joined with separators; one search finds all words of a piece, and the offsets of the texts tell
    whose they are. A run whose first and last word are of different texts is none. The last words of a piece
    are carried over, so that runs of a text that comes in parts are whole.
    """
    doc, row = np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    for numbers, blob, offsets in _joined(texts):
        word = _IS_WORD[np.frombuffer(blob, np.uint8)]
        starts = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
        own = numbers[np.searchsorted(offsets, starts, "right") - 1]
        old = len(doc)
        doc, row = np.concatenate([doc, own]), np.concatenate([row, words.of(_WORD.findall(blob))])
        crc, found = row[:, 0].astype(np.uint32), [(doc[old:], row[old:, 0] % buckets)]
        for n in range(1, RUN):
            if len(doc) <= n:
                break
            # runs of n + 1 words, by their first word
            crc = shifted(crc[:-1], row[n:, 2]) ^ row[n:, 1].astype(np.uint32)
            whole = (doc[:-n] == doc[n:]) & (np.arange(n, len(doc)) >= old)
            found.append((doc[n:][whole], crc[whole].astype(np.int64) % buckets))
        yield own, found
        doc, row = doc[1 - RUN :], row[1 - RUN :]


def _joined(texts: list[bytes]) -> Iterator[tuple[np.ndarray, bytes, np.ndarray]]:
    numbers, parts, size = [], [], 0

    def piece() -> tuple[np.ndarray, bytes, np.ndarray]:
        lengths = np.array([len(p) + len(SENTINEL) for p in parts], np.int64)
        return np.array(numbers), SENTINEL.join(parts), np.cumsum(lengths) - lengths

    for i, part in _parts(texts):
        if parts and size + len(part) > PIECE_BYTES:
            yield piece()
            numbers, parts, size = [], [], 0
        numbers.append(i)
        parts.append(part)
        size += len(part) + len(SENTINEL)
    if parts:
        yield piece()


def _lowered(column: pa.Array) -> list[bytes]:
    return [t.translate(_LOWER) for t in column.cast(pa.large_binary()).to_pylist()]


def bucket_counts(rows: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. A task sends one row for each bucket at most."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = Words(), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found in features(_lowered(batch.column(0)), words, buckets):
                for _, bucket in found:
                    total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    counts = rows.select(kept_text(f"`{text}`").alias("t")).mapInArrow(counted, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of each bucket's share in the target over that in the corpus, one added to every count."""
    t, s = target.astype(float), corpus.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t))))).astype(np.int64)


def _noise(id_column: Column, seed: int) -> Column:
    """Gumbel noise from a hash of the id, in thousandths."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def weighed(docs: DataFrame, gains: np.ndarray, carried: list[str], text: str = "text") -> DataFrame:
    """``doc`` (the carried columns), n_words, n_features and weight of every row."""
    held = docs.sparkSession.sparkContext.broadcast(gains)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, gain = Words(), held.value
        for batch in batches:
            n = batch.num_rows
            n_words, n_features, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for own, found in features(_lowered(batch.column(1)), words, len(gain)):
                n_words += np.bincount(own, minlength=n)
                for doc, bucket in found:
                    n_features += np.bincount(doc, minlength=n)
                    # sums of whole numbers far below 2**53: doubles hold them exactly
                    weight += np.bincount(doc, weights=gain[bucket], minlength=n).astype(np.int64)
            columns = [batch.column(0), *map(pa.array, (n_words, n_features, weight))]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "n_words", "n_features", "weight"])

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in carried)).alias("doc"), kept_text(f"`{text}`").alias("t"))
    schema = rows.select("doc", *(F.lit(0).cast("long").alias(c) for c in ("n_words", "n_features", "weight"))).schema
    return rows.mapInArrow(judged, schema)


def resampled(
    docs: DataFrame,
    target: DataFrame,
    carried: list[str] | None = None,
    id_col: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of ``docs``: ``doc`` (a struct of the carried columns, all unless given), n_words, n_features,
    weight, score, and rank of those that are drawn.

    A feature is a run of 1 to 3 words; its bucket's gain is the logarithm of its share in ``target`` over that in
    ``docs``, and a document's weight the sum of its gains. With Gumbel noise from a hash of seed and id added, the
    highest scores are a draw without replacement. Of the documents with ``min_words`` words, ``percent`` in a
    hundred are drawn, rounded down; ties go to the smaller id, null last, and equal ids in any order. Ranks come
    from one range partitioning by score, so no task and no window sees more than its range, whatever the ties.

    A null or empty text has no words and weight 0 and is never drawn. A null id is hashed as an empty one. Repeated
    rows get the same score and are drawn one by one. Texts of any length are worked on in pieces. The carried
    columns stand in a struct, so their names clash with nothing. Without a target's text all features are
    equally rare there.
    """
    carried = docs.columns if carried is None else carried
    kept = list(dict.fromkeys([*carried, id_col]))
    gains = bucket_gains(bucket_counts(docs, text), bucket_counts(target, target_text))
    scored = weighed(docs, gains, kept, text)
    score = F.col("weight") + _noise(F.col(f"doc.`{id_col}`"), seed)
    scored = written(scored.select("*", score.alias("score"), F.monotonically_increasing_id().alias("row")), "importance")
    n_drawn = percent * scored.where(F.col("n_words") >= min_words).count() // 100

    order = [F.col("n_words") < min_words, F.desc("score"), F.asc_nulls_last(f"doc.`{id_col}`"), F.col("row")]
    ranged = scored.repartitionByRange(*order).sortWithinPartitions(*order)
    # the lower 33 bits of this number count the rows of a partition
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranged = written(ranged.select("*", F.spark_partition_id().alias("part"), place.alias("at")), "importance-order")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("part", before.alias("start")))  # one row for each partition
    rank = F.col("start") + F.col("at") + 1
    out = F.struct(*(F.col(f"doc.`{c}`") for c in carried)).alias("doc")
    return ranged.join(starts, "part").select(
        out, "n_words", "n_features", "weight", "score", F.when(rank <= n_drawn, rank).alias("rank")
    )


shipped(__name__)
