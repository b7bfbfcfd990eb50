"""Repeated strings by longest factors of sparse suffix arrays, taken at content-chosen anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import byte_size, kept_text, semi_filtered, shipped, written
from fleetlens.llm.textbytes import constants, mixed, pieces, prefix_hash, span_hash

#: Bytes of a repeated string.
LENGTH = 400
#: Each window of LENGTH bytes has as its anchor the gram with the smallest hash among CHOICES.
CHOICES = 256
GRAM = LENGTH - CHOICES + 1
#: Suffixes that one sparse suffix array holds at most. Larger groups are parted by longer grams.
GROUP = 256
#: Suffixes whose arrays one call works on together, at least; a group of equal grams is never parted.
TOGETHER = 2048
#: A key with more than one in HOT_SHARE of all rows is hot. There are at most HOT_SHARE such keys, so their facts are broadcast.
HOT_SHARE = 1000
#: Widths of the stretches of windows that larger groups are parted into, in turn.
CELLS = [32, 4, 1]
#: Contexts that a call holds at most before it sends them on, each of less than LENGTH + CHOICES bytes.
SENT_ROWS = 4096
#: Rows that it turns into Python values at once.
SLICE = 256
#: Bytes of text whose anchors are searched at once, unless one text has more. Each takes about fifty bytes meanwhile.
SEARCHED_BYTES = 1 << 17
_VALUES = constants(23, 256)
_OFFSET = np.uint64(0xD6E8FEB86659FD93)
CONTEXT_NAMES = ["g", "s", "n", "a_low", "a_high", "left", "right", "g0", "s0", "id", "text_key", "at"]


def _anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document, anchor, first and last window, gram hash and segment hash of each anchor of a piece.

    A segment is all the windows of an anchor. Equal windows have their anchor in the same place, as only the
    bytes of the window decide on it: the smallest hash, of equal ones the first.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix = prefix_hash(_VALUES[data])
    at = np.arange(n - GRAM + 1)
    least = (span_hash(prefix, at, at + GRAM) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    step = 1
    while step < CHOICES:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    whole = np.zeros(n + 1, np.int8)
    starts, ends = offsets[:-1], offsets[1:] - LENGTH + 1
    long = ends > starts
    np.add.at(whole, starts[long], 1)
    np.add.at(whole, ends[long], -1)
    windows = np.flatnonzero(np.cumsum(whole[: len(least)]))
    if not len(windows):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    anchor = (least[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.searchsorted(offsets, windows, "right") - 1
    cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])) + 1
    firsts, lasts = np.r_[0, cut], np.r_[cut - 1, len(windows) - 1]
    x, low, high = anchor[firsts], windows[firsts], windows[lasts]
    gram = span_hash(prefix, x, x + GRAM)
    segment = mixed(span_hash(prefix, low, high + LENGTH) + (x - low).astype(np.uint64) * _OFFSET)
    base = offsets[doc[firsts]]
    return doc[firsts], x - base, low - base, high - base, gram, segment


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, _, data, offsets in pieces(batch.column("text"), SEARCHED_BYTES):
            doc, x, low, high, gram, segment = _anchors(data, offsets)
            rows = pa.array(doc + first)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(rows),
                    batch.column("text_key").take(rows),
                    *(pa.array(v) for v in (x, low, high)),
                    pa.array(gram.view(np.int64)),
                    pa.array(segment.view(np.int64)),
                ],
                ["id", "text_key", "x", "low", "high", "g", "s"],
            )


def _dicts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of batches, a slice at a time, as what Python makes of them takes several times their bytes."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            yield from batch.slice(start, SLICE).to_pylist()


def _sent(contexts: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Contexts in batches of bounded size, however many come of one batch of the input."""
    while out := list(islice(contexts, SENT_ROWS)):
        yield pa.RecordBatch.from_pylist(out, schema)


def _context_schema(id_type: pa.DataType) -> pa.Schema:
    kinds = {"a_low": pa.int32(), "a_high": pa.int32(), "left": pa.binary(), "right": pa.binary(), "id": id_type}
    return pa.schema([(name, kinds.get(name, pa.int64())) for name in CONTEXT_NAMES])


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the segments whose first anchor a document has, on the left and on the right of the anchor."""

    def contexts(batch: pa.RecordBatch) -> Iterator[dict]:
        for row in _dicts(iter([batch])):
            data = row["text"].encode("utf-8", "surrogatepass")
            for p in row["places"]:
                yield {
                    "g": p["g"],
                    "s": p["s"],
                    "n": p["n"],
                    "a_low": p["x"] - p["high"],
                    "a_high": p["x"] - p["low"],
                    "left": data[p["low"] : p["x"]],
                    "right": data[p["x"] : p["high"] + LENGTH],
                    "g0": p["g"],
                    "s0": p["s"],
                    "id": row["id"],
                    "text_key": row["text_key"],
                    "at": p["x"],
                }

    for batch in batches:
        yield from _sent(contexts(batch.select(["id", "text_key", "text", "places"])), _context_schema(batch.schema.field("id").type))


def _common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low if high == low or a[low : low + 1] != b[low : low + 1] else low + 1


def _moved_left(order: np.ndarray, lcp: np.ndarray, group: np.ndarray, byte: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The array of the suffixes that start one byte further left, from that of the present ones.

    ``byte`` is what each suffix gains. Sorting by it alone keeps the present order among equals, which is the
    order of the longer suffixes; two of them share one byte more than the least common prefix between them.
    """
    ranks = np.flatnonzero(there[order])
    key = group[order[ranks]] * 256 + byte[order[ranks]]
    turn = np.argsort(key, kind="stable")
    ranks, key = ranks[turn], key[turn]
    moved = np.zeros(len(ranks), np.int64)
    same = np.flatnonzero(key[1:] == key[:-1])
    if len(same):
        edges = np.stack([ranks[same] + 1, ranks[same + 1] + 1], axis=1).ravel()
        moved[same + 1] = 1 + np.minimum.reduceat(np.r_[lcp, 0], edges)[::2]
    return order[ranks], moved


def longest_factors(position: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """For each suffix of an array the longest prefix that a suffix at a smaller position has too.

    That suffix is the previous or the next one in the array at a smaller position. ``lcp`` is the common prefix
    with the one before, 0 where a group begins. A factor below ``least`` is told as some number below it.
    """

    def scanned(p: np.ndarray, reach: np.ndarray) -> np.ndarray:
        smaller = np.arange(len(p)) - 1
        on = np.flatnonzero(reach >= least)
        on = on[p[smaller[on]] > p[on]]
        while len(on):  # what lies between a suffix and its candidate is at greater positions, so candidates are passed on
            via = smaller[on]
            reach[on], smaller[on] = np.minimum(reach[on], reach[via]), smaller[via]
            on = on[reach[on] >= least]
            on = on[p[smaller[on]] > p[on]]
        return reach

    after = scanned(position[::-1], np.r_[0, lcp[:0:-1]])[::-1]
    return np.maximum(scanned(position, lcp.copy()), after)


def repeated_offsets(
    contexts: list[tuple[bytes, bytes, int, int]], groups: list[int] | None = None, only_later: bool = False
) -> list[list[tuple[int, int]]]:
    """For each context (left, right, a_low, a_high) the runs of offsets whose windows another one of its group has too.

    Contexts come in the order of their positions; with ``only_later`` the other one must be an earlier context.

    The right parts, suffixes from the anchor on, are sorted within their group and have their longest common
    prefixes. The arrays of the suffixes that start 1, 2, ... bytes before the anchor follow from it. In each of them
    a window repeats if the longest factor at smaller positions, or that at greater ones, has LENGTH bytes.
    """
    m = len(contexts)
    group = np.array(groups if groups is not None else [0] * m, np.int64)
    a_high = np.array([c[3] for c in contexts], np.int64)
    width = int(a_high.max(initial=-1)) + 1
    before = np.zeros((m, width), np.uint8)
    for i, (left, _, _, _) in enumerate(contexts):
        before[i, : len(left)] = np.frombuffer(left, np.uint8)[::-1]
    order = np.array(sorted(range(m), key=lambda i: (group[i], contexts[i][1])), np.int64)
    lcp = np.zeros(m, np.int64)
    for r in range(1, m):
        i, j = order[r - 1], order[r]
        if group[i] == group[j]:
            lcp[r] = _common(contexts[i][1], contexts[j][1])
    hit = np.zeros((m, width + 2), np.int8)
    for a in range(width):
        if a:
            order, lcp = _moved_left(order, lcp, group, before[:, a - 1], a_high >= a)
        if not (lcp >= LENGTH).any():
            continue
        found = longest_factors(order, lcp, LENGTH) >= LENGTH
        if not only_later:
            found |= longest_factors(-order, lcp, LENGTH) >= LENGTH
        hit[order[found], a + 1] = 1
    edges = np.diff(hit, axis=1)
    owner, first = np.nonzero(edges == 1)
    last = np.nonzero(edges == -1)[1] - 1
    runs: list[list[tuple[int, int]]] = [[] for _ in contexts]
    for i, low, high in zip(owner.tolist(), first.tolist(), last.tolist(), strict=True):
        runs[i].append((low, high))
    return runs


def _position(row: dict) -> tuple:
    """Sorts as Spark sorts (id, text_key, at): null comes first."""
    known = row["id"] is not None
    return (known, row["id"] if known else 0, row["text_key"], row["at"])


def _array_rows(keep_first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come sorted by g: one sparse suffix array for each g. Equal segments are one suffix that repeats.

    With ``keep_first`` the runs are those of the segment's first anchor.
    """

    def together(rows: list[dict]) -> pa.RecordBatch:
        rows.sort(key=_position)
        runs = repeated_offsets([(r["left"], r["right"], r["a_low"], r["a_high"]) for r in rows], [r["part"] for r in rows], keep_first)
        out: dict[str, list] = {"g0": [], "s0": [], "a_first": [], "a_last": []}
        for row, own in zip(rows, runs, strict=True):
            for first, last in own if keep_first or row["n"] == 1 else [(row["a_low"], row["a_high"])]:
                for name, value in zip(out, (row["g0"], row["s0"], first, last), strict=True):
                    out[name].append(value)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[dict] = []
        for part, (_, group) in enumerate(groupby(_dicts(batches), key=lambda r: r["g"])):
            waiting += ({**r, "part": part} for r in group)
            if len(waiting) >= TOGETHER:
                yield together(waiting)
                waiting = []
        yield together(waiting)

    return arrays


def _parted(cell: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cuts contexts into stretches of ``cell`` offsets. All windows of a stretch share a core, the new gram.

    A stretch of one window is its core, so its gram stands for it and its bytes are not sent on.
    """

    def stretches(batch: pa.RecordBatch) -> Iterator[dict]:
        for r in _dicts(iter([batch])):
            left, right, x = r["left"], r["right"], len(r["left"])
            both = left + right
            for c in range(r["a_low"] // cell, r["a_high"] // cell + 1):
                low, high = max(r["a_low"], c * cell), min(r["a_high"], c * cell + cell - 1)
                core = both[x - c * cell : x + LENGTH - (c * cell + cell - 1)]
                own = both[x - high : x + LENGTH - low]
                yield {
                    "g": _digest(b"%d:%d:" % (r["g"], c) + core),
                    "s": _digest(b"%d:" % (high - low) + own) if cell > 1 else 0,
                    "n": r["n"],
                    "a_low": low,
                    "a_high": high,
                    "left": both[x - high : x] if cell > 1 else b"",
                    "right": both[x : x + LENGTH - low] if cell > 1 else b"",
                    **{name: r[name] for name in ("g0", "s0", "id", "text_key", "at")},
                }

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _sent(stretches(batch), batch.schema)

    return part


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


CONTEXT = "g long, s long, n long, a_low int, a_high int, left binary, right binary, g0 long, s0 long, id {kind}, text_key long, at long"
POSITION = ("id", "text_key", "at")


def _joined(rows: DataFrame, facts: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Rows with the facts of their keys, of which ``count`` says how many of ``total`` rows have them.

    Hot keys meet their facts by broadcast, so that no task gets all rows of a key; the others are shuffled.
    """
    hot = facts.where(F.col(count) > total / HOT_SHARE)
    direct = rows.join(F.broadcast(hot), keys)
    others = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti")
    return direct.unionByName(others.join(facts.where(F.col(count) <= total / HOT_SHARE), keys))


def _repeats(contexts: DataFrame, kind: str, keep_first: bool) -> DataFrame:
    """(g0, s0, a_first, a_last): runs of repeated windows of each segment, or of its first anchor (``keep_first``).

    Groups of equal grams that one task can hold get a sparse suffix array. Larger ones, as of a passage that
    very many documents share, are parted by stretches of windows, whose longer grams make smaller groups; in
    the end a stretch is one window, and a group of them needs only its count and its first position.
    """
    found = []
    for cell in [*CELLS, 0]:
        size = contexts.groupBy("g").agg(F.count("*").alias("rows"), F.sum("n").alias("copies"), F.min(F.struct(*POSITION)).alias("least"))
        facts = written(size.where("rows > 1" if keep_first else "copies > 1"), "context-groups")
        sized = _joined(contexts, facts, ["g"], "rows", contexts.count())
        if cell == 0:
            later = F.struct(*POSITION) != F.col("least") if keep_first else F.lit(True)
            found.append(sized.where(later).select("g0", "s0", F.col("a_low").alias("a_first"), F.col("a_high").alias("a_last")))
            break
        small = sized.where(F.col("rows") <= GROUP).select(contexts.columns)
        arrays = small.repartition("g").sortWithinPartitions("g")
        found.append(arrays.mapInArrow(_array_rows(keep_first), "g0 long, s0 long, a_first int, a_last int"))
        large = sized.where(F.col("rows") > GROUP).select(contexts.columns)
        contexts = written(large.mapInArrow(_parted(cell), CONTEXT.format(kind=kind)), "contexts")
        if contexts.isEmpty():
            break
    result = found[0]
    for more in found[1:]:
        result = result.union(more)
    return result


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(start, SLICE) for b in batches for start in range(0, b.num_rows, SLICE)):
        removed, spans, digests = [], [], []
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            merged: list[list[int]] = []
            for r in sorted((r["first"], r["last"] + LENGTH) for r in runs):
                if merged and r[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], r[1])
                else:
                    merged.append([*r])
            edges = [0, *(e for m in merged for e in m), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            removed.append(len(data) - len(kept))
            spans.append([{"start": a, "end": b} for a, b in merged])
            digests.append(hashlib.sha256(kept).hexdigest())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        carried = [batch.column(n) for n in ("id", "n_bytes")]
        columns = [*carried, pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(digests, pa.string()), batch.column("copies")]
        yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_removed", "spans", "kept_sha256", "copies"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep_first: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, spans (start, end) in bytes, kept_sha256.

    A byte is removed if it is covered by a string of LENGTH bytes that also starts anywhere else, in the same
    text or another one; with ``keep_first`` only if it also starts earlier, by (id, hash of the text, place), so
    that one copy stays. Strings are judged on the input. ``spans`` are the maximal removed runs.

    A full suffix array would sort every byte of the corpus. Here suffixes are taken at anchors only: every
    window of LENGTH bytes names one gram inside it by a rule that looks at the window alone, so equal windows
    name the same place. Anchors are grouped by gram. Where all windows around the anchors of a group are
    equal, or the group has one anchor, that settles it. Otherwise, near the ends of repeated passages, the
    longest factors at smaller and at greater positions, from sparse suffix arrays of the group's contexts, tell
    the windows that repeat.

    A null or empty text has no bytes, and a text below LENGTH bytes loses none. A text is held whole by one task,
    and searched in pieces. Ids may be null or repeated. Rows equal in id and text count as copies of each other;
    with ``keep_first`` they are one text, as ``dropDuplicates`` sees them. Other columns are not read.
    """
    t = kept_text(f"`{text}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(t).alias("text_key"), t.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    long = rows.where(F.octet_length("text") >= LENGTH)
    columns = f"id {kind}, text_key long, x long, low long, high long, g long, s long"
    anchors = written(long.mapInArrow(_anchor_rows, columns), "anchors")
    total = anchors.count()
    groups = anchors.groupBy("g").agg(F.count("*").alias("anchors"), F.min("s").alias("s_min"), F.max("s").alias("s_max"))
    groups = written(groups.where("anchors > 1").select("g", "anchors", (F.col("s_min") != F.col("s_max")).alias("differ")), "anchor-groups")
    met = written(_joined(anchors, groups, ["g"], "anchors", total).drop("anchors"), "met-anchors")

    # the first anchor stands for all with an equal segment
    lead = F.min(F.struct("id", "text_key", "x", "low", "high")).alias("lead")
    judged = met if keep_first else met.where("differ")
    segments = written(judged.groupBy("g", "s").agg(F.count("*").alias("n"), F.first("differ").alias("differ"), lead), "segments")
    place = F.struct("g", "s", "n", "lead.x", "lead.low", "lead.high")
    leads = segments.where("differ").groupBy("lead.id", "lead.text_key")
    places = written(leads.agg(F.collect_list(place).alias("places")), "places")
    chosen = _with_texts(long, places, "places").mapInArrow(_context_rows, CONTEXT.format(kind=kind))
    repeats = _repeats(written(chosen, "contexts"), kind, keep_first)

    # a row per segment, so that the join gives a row per anchor however many runs a segment has
    run = F.struct(F.col("a_first"), F.col("a_last"))
    offsets = repeats.groupBy(F.col("g0").alias("g"), F.col("s0").alias("s")).agg(F.collect_set(run).alias("offsets"))
    noted = segments.join(offsets, ["g", "s"], "left" if keep_first else "inner").select("g", "s", "n", "lead", "offsets")
    own = _joined(judged, written(noted, "noted-segments"), ["g", "s"], "n", total)
    x = F.col("x")
    in_text = F.transform("offsets", lambda r: F.struct((x - r["a_last"]).alias("first"), (x - r["a_first"]).alias("last")))
    whole_segment = F.array(F.struct(F.col("low").alias("first"), F.col("high").alias("last")))
    if keep_first:
        is_lead = F.col("id").eqNullSafe(F.col("lead.id")) & (F.col("text_key") == F.col("lead.text_key")) & (x == F.col("lead.x"))
        found = own.select("id", "text_key", F.when(is_lead, in_text).otherwise(whole_segment).alias("runs")).where("runs is not null")
    else:
        found = own.select("id", "text_key", in_text.alias("runs")).union(met.where("not differ").select("id", "text_key", whole_segment))
    # equal rows bring equal runs, which are merged before the shuffle
    runs = written(found.groupBy("id", "text_key").agg(F.flatten(F.collect_set("runs")).alias("runs")), "runs")
    sized = rows.withColumn("n_bytes", byte_size(F.col("text")))
    cleaned = f"id {kind}, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string, copies long"
    changed = _with_texts(sized, runs, "runs").mapInArrow(_cleaned, cleaned)
    changed = changed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copy", "copies")
    whole = sized.select("id", "text_key", "n_bytes", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    unchanged = whole.join(runs.select("id", "text_key").alias("r"), _same(whole, F.col("r.id"), F.col("r.text_key")), "left_anti")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    unchanged = unchanged.select("id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), none.alias("spans"), "kept_sha256")
    return changed.unionByName(unchanged).withColumnRenamed("id", id_col)


def _same(rows: DataFrame, id_: Column, text_key: Column) -> Column:
    return rows["id"].eqNullSafe(id_) & (rows["text_key"] == text_key)


def _with_texts(rows: DataFrame, notes: DataFrame, name: str) -> DataFrame:
    """One row for all that are equal in id and text, with what is noted of them and how many copies there are.

    The texts of the others are dropped before the shuffle, and equal rows become one before it.
    """
    keys = [F.xxhash64("id").alias("id_key"), F.col("text_key")]
    some = semi_filtered(rows, F.col("text_key"), notes, F.col("text_key"))
    firsts = [F.first(c).alias(c) for c in rows.columns if c != "text_key"]
    once = some.groupBy(*keys).agg(*firsts, F.count("*").alias("copies"))
    return once.join(notes.select(*keys, name), ["id_key", "text_key"]).select(*rows.columns, "copies", name)


shipped(__name__)
