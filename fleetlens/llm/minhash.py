"""Near duplicates by min-max hashing: minimum and maximum under each permutation, in bands."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import kept_text, semi_filtered, shipped, written
from fleetlens.llm.graph import components
from fleetlens.llm.textbytes import constants, mixed, pieces, prefix_hash, span_hash

SHINGLE = 5
#: Least similarity of linked documents, in percent, unless a caller asks for another.
SIMILARITY = 85
#: Chance that a pair of just the least similarity agrees in no band.
MISSED = 2e-6
#: A block of a large group has about so many members and shingles at most.
BLOCK_MEMBERS = 192
BLOCK_SHINGLES = 1 << 16
_CHUNK = 1 << 15

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_VALUES = constants(7, 256)
_PLACE = constants(11, SHINGLE)


def n_bands(similarity: int) -> int:
    """How many bands leave a pair at ``similarity`` percent unseen with a chance of ``MISSED`` at most.

    Two permutations give a band of four: their minima and maxima. A pair agrees in each with the chance of its
    similarity, so at 0.85 in a band with probability 0.52. 18 bands are needed at 0.85, 25 at 0.8, 204 at 0.5.
    """
    if not 0 < similarity <= 100:
        raise ValueError(f"similarity is in percent, above 0: {similarity}")
    if similarity == 100:
        return 1
    return math.ceil(math.log(MISSED) / math.log1p(-((similarity / 100) ** 4)))


def _shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """For each document of a piece the sorted distinct hashes of its shingles.

    A shingle is five words in a row; a text with fewer words has its whole sequence as the only one.
    """
    n_docs = len(offsets) - 1
    low = _LOWER[data]
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = ~_GAP[low]
    firsts = np.zeros(len(low) + 1, bool)
    firsts[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | firsts[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | firsts[1:])) + 1
    words = span_hash(prefix_hash(_VALUES[low]), starts, ends)
    bounds = np.searchsorted(starts, offsets)
    padded = np.concatenate([words, np.zeros(SHINGLE, np.uint64)])
    whole = sum((padded[i : len(words) + i] * _PLACE[i] for i in range(SHINGLE)), np.zeros(len(words), np.uint64))
    whole = mixed(whole)
    for d in range(n_docs):
        a, b = bounds[d], bounds[d + 1]
        n = b - a
        if n >= SHINGLE:
            s = np.sort(whole[a : b - SHINGLE + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif n:
            yield mixed((words[a:b] * _PLACE[:n]).sum(keepdims=True) + np.uint64(n))
        else:
            yield whole[:0]


def _bands(s: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Band hashes of a set: of minimum and maximum under each two permutations."""
    low = np.full(len(factors), 2**64 - 1, np.uint64)
    high = np.zeros(len(factors), np.uint64)
    for i in range(0, len(s), _CHUNK):
        h = s[None, i : i + _CHUNK] * factors[:, None] + shifts[:, None]
        np.minimum(low, h.min(axis=1), out=low)
        np.maximum(high, h.max(axis=1), out=high)
    rows = np.stack([low[0::2], high[0::2], low[1::2], high[1::2]])
    total = np.arange(len(factors) // 2, dtype=np.uint64) + np.uint64(101)
    for r in rows:
        total = mixed(total + r)
    return total


def _signatures(batches: Iterator[pa.RecordBatch], count: int) -> Iterator[pa.RecordBatch]:
    factors, shifts = constants(13, 2 * count), constants(17, 2 * count)
    for batch in batches:
        sizes, keys = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.uint64)
        bands = np.zeros((len(batch), count), np.uint64)
        for first, _, data, offsets in pieces(batch.column("text")):
            for i, s in enumerate(_shingle_sets(data, offsets), first):
                sizes[i], keys[i] = len(s), mixed(s).sum()
                if len(s):
                    bands[i] = _bands(s, factors, shifts)
        kept = [batch.column(i) for i in range(batch.num_columns - 1)]
        columns = [*kept, pa.array(sizes), pa.array(keys.view(np.int64)), *(pa.array(b.view(np.int64)) for b in bands.T.copy())]
        names = [*batch.schema.names[:-1], "n_shingles", "k", *(f"b{i}" for i in range(count))]
        yield pa.RecordBatch.from_arrays(columns, names)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in pieces(batch.column("text")):
            sets = list(_shingle_sets(data, offsets))
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column("k").slice(first, last - first), lists], ["k", "shingles"])


def signatures(docs: DataFrame, id_col: str, text: str, similarity: int) -> DataFrame:
    """One row per row of ``docs``: id, text_key, n_shingles, k (a hash of the shingle set), b0, b1, ..."""
    t = kept_text(f"`{text}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(t).alias("text_key"), t.alias("text"))
    kind = dict(rows.dtypes)["id"]
    count = n_bands(similarity)
    bands = ", ".join(f"b{i} long" for i in range(count))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _signatures(batches, count)

    return rows.mapInArrow(signed, f"id {kind}, text_key long, n_shingles long, k long, {bands}")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one = sets.select(F.col("k").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("k").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    joined = pairs.join(one, "a").join(two, "b").withColumn("common", common)
    union = F.size("sa") + F.size("sb") - F.col("common")
    return joined.where(100 * F.col("common") >= similarity * union).select("a", "b")


def _star_pairs(buckets: DataFrame) -> DataFrame:
    """Each member of a bucket with the member that shares buckets with most others."""
    weight = buckets.groupBy("k").agg(F.sum("n").alias("weight"))
    weighed = buckets.join(weight, "k")
    centre = weighed.groupBy("v").agg(F.max(F.struct("weight", "k")).alias("c")).select("v", F.col("c.k").alias("b"))
    pairs = buckets.join(centre, "v").where("k <> b").select(F.col("k").alias("a"), "b")
    return pairs.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: id, text_key, n_shingles, component_id (the smallest id reachable by links), root.

    Documents with equal shingle sets are one node. Nodes with an equal band stand in a bucket. In each bucket
    all are first compared with its centre, which joins most groups of copies in a number of comparisons that is
    linear in their size. Members that the centre leaves apart are then compared with the whole group in
    blocks, so that no link of a bucket is lost. All comparisons are made on the full sets.

    ``root`` is the same for all rows of a group and differs between groups, also where ids are null or repeated.

    A null or empty text has no shingles and no links. Its component is its own id, its root null. Ids may be
    repeated: equal rows are linked like any others. A null id never names a component unless all ids of it are null. Other
    columns are not read. Sets and nodes are told apart by 64-bit hashes.
    """
    signed = written(signatures(docs, id_col, text, similarity), "signatures")
    bands = [f"b{i}" for i in range(n_bands(similarity))]
    nodes = signed.where("n_shingles > 0").groupBy("k").agg(
        F.min("n_shingles").alias("n_shingles"), *(F.min(b).alias(b) for b in bands)
    )
    nodes = written(nodes, "nodes")
    placed = nodes.select("k", F.explode(F.array(*bands)).alias("v"))
    full = placed.groupBy("v").agg(F.count("*").alias("n")).where("n > 1")
    buckets = written(placed.join(full, "v"), "buckets")

    t = kept_text(f"`{text}`")
    wanted = buckets.select("k").distinct().join(signed.select("k", "id", "text_key"), "k").groupBy("k").agg(
        F.min("text_key").alias("wanted_text")
    )
    wanted = written(wanted, "wanted")
    one_id = signed.join(wanted.withColumnRenamed("k", "wk"), F.expr("k = wk and text_key = wanted_text")).groupBy("k", "text_key").agg(F.min("id").alias("wid"))
    texts = docs.select(F.col(f"`{id_col}`").alias("did"), F.xxhash64(t).alias("tk"), t.alias("text"))
    texts = semi_filtered(texts, F.col("tk"), wanted, F.col("wanted_text"))
    texts = texts.join(one_id, F.expr("tk = text_key and did <=> wid")).select("k", "text")
    sets = written(texts.mapInArrow(_sets, "k long, shingles array<long>"), "shingle-sets")

    pairs = written(_star_pairs(buckets), "star-pairs")
    stars = written(_verified(pairs, sets, similarity), "star-links")
    labels = written(components(stars), "star-components")
    rest = _block_links(pairs, labels, nodes.select("k", "n_shingles"), sets, similarity)
    labels = components(written(stars.union(rest), "links"))
    named = signed.join(labels.select(F.col("node").alias("k"), "root"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    named = written(named.select("id", "text_key", "n_shingles", "root"), "labelled")
    least = named.where("n_shingles > 0").groupBy("root").agg(F.min("id").alias("component_id"))
    linked = named.where("n_shingles > 0").join(least, "root")
    alone = named.where("n_shingles = 0").withColumns({"component_id": F.col("id"), "root": F.lit(None).cast("long")})
    columns = [F.col("id").alias(id_col), "text_key", "n_shingles", "component_id", "root"]
    return linked.select(*columns).unionByName(alone.select(*columns))


def _block_links(pairs: DataFrame, labels: DataFrame, sizes: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links between members of a group that its centre has not joined.

    A group is a centre and all that share a bucket with it. Members that are still apart from the centre are
    compared with all members, block against block: blocks hold a bounded number of members and shingles, so a
    task sees two of them however large the group. Groups that the centre has joined need no more work.
    """
    group = pairs.select(F.col("b").alias("c"), F.col("a").alias("k")).union(pairs.select(F.col("b"), F.col("b")).distinct())
    roots = labels.select(F.col("node").alias("k"), "root")
    group = group.join(roots, "k", "left").withColumn("root", F.coalesce("root", "k")).join(sizes, "k")
    centres = pairs.select(F.col("b").alias("c")).distinct().join(roots, F.col("c") == roots["k"], "left")
    centres = centres.select("c", F.coalesce("root", "c").alias("c_root"))
    group = group.join(centres, "c").withColumn("apart", F.col("root") != F.col("c_root"))

    def blocks(which: str) -> Column:
        members, shingles = f"count_if({which})", f"sum(if({which}, n_shingles, 0))"
        return F.expr(f"cast(ceil(greatest({members} / {BLOCK_MEMBERS}, {shingles} / {BLOCK_SHINGLES})) as int)")

    counts = [blocks("apart").alias("n_apart"), blocks("not apart").alias("n_joined"), F.count("*").alias("n")]
    shape = group.groupBy("c").agg(*counts)
    open_ = group.join(shape.where("n_apart > 0 and n > 2"), "c")
    own = F.pmod(F.xxhash64("k"), F.when(F.col("apart"), F.col("n_apart")).otherwise(F.col("n_joined"))).cast("int")

    def pair(kind: str, i: Column | str, j: Column | str) -> Column:
        return F.concat_ws(":", F.lit(kind), i, j)

    def up_to(n: str) -> Column:
        return F.sequence(F.lit(0), F.greatest(F.col(n) - 1, F.lit(0)))

    both_apart = F.transform(up_to("n_apart"), lambda j: pair("a", F.least("own", j), F.greatest("own", j)))
    to_joined = F.when(F.col("n_joined") > 0, F.transform(up_to("n_joined"), lambda j: pair("j", F.col("own"), j)))
    from_joined = F.transform(up_to("n_apart"), lambda i: pair("j", i, F.col("own")))
    placed = F.when(F.col("apart"), F.concat(both_apart, F.coalesce(to_joined, F.array().cast("array<string>")))).otherwise(from_joined)
    rows = open_.withColumn("own", own).withColumn("pair", F.explode(placed)).select("c", "pair", "k", "root")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        return _spanning_links(rows, similarity)

    return rows.join(sets, "k").groupBy("c", "pair").applyInPandas(compare, "a long, b long")


def _spanning_links(rows: pd.DataFrame, similarity: int) -> pd.DataFrame:
    """Links that join what similar members of two blocks can join: fewer than there are members."""
    keys, roots = rows["k"].to_numpy(), rows["root"].to_numpy()
    sets = list(rows["shingles"])
    sizes = np.array([len(s) for s in sets])
    member = np.repeat(np.arange(len(sets)), sizes)
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    column = np.cumsum(shared) - 1
    kept = shared[place]
    matrix = np.zeros((len(sets), int(shared.sum())), np.float32)
    matrix[member[kept], column[place[kept]]] = 1
    common = np.rint(matrix @ matrix.T).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    similar = (100 * common >= similarity * union) & (roots[:, None] != roots[None, :])
    parent = {r: r for r in roots}

    def top(r: int) -> int:
        while parent[r] != r:
            parent[r] = r = parent[parent[r]]
        return r

    links = []
    for i, j in zip(*np.nonzero(np.triu(similar)), strict=True):
        a, b = top(roots[i]), top(roots[j])
        if a != b:
            parent[a] = b
            links.append((keys[i], keys[j]))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


shipped(__name__)
