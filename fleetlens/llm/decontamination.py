"""Benchmark decontamination by spaced seeds: masks that ignore some words, then a check around each hit."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import kept_text, unused, written

#: A stretch of so many aligned words, or the whole item if it is shorter, must agree in SHARE percent of them.
STRETCH = 16
SHARE = 80
#: Words before a seed that are compared, and from its start on: any stretch that holds the seed lies within.
PAD = STRETCH - 1
#: Items with fewer words are no evidence.
MIN_WORDS = 5
#: Below so many words an item is evidence only if all its words agree: four of five are common talk.
SURE_WORDS = 8
#: Masks of a length of stretch, at most. The heaviest masks are taken of which so many miss no accepted stretch.
MASKS = 4
#: Distinct seeds (8 bytes each) that are broadcast; more are joined by a shuffle.
MAX_BROADCAST_SEEDS = 1_000_000


def _tokens(text: Column) -> Column:
    """Hashes of the words of a text: runs of letters and digits in lower case."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _covering(length: int, changes: int, weight: int) -> list[str]:
    """Masks of a weight (words at 0 may differ), the fewest that a greedy search finds, of which one fits
    somewhere into a stretch of ``length`` words wherever ``changes`` of them differ."""
    patterns = [sum(1 << i for i in p) for p in combinations(range(length), changes)]
    fits = {}
    for span in range(weight, length + 1):
        for inner in combinations(range(1, span - 1), weight - 2):
            mask = sum(1 << i for i in (0, *inner, span - 1))
            placed = [mask << at for at in range(length - span + 1)]
            fits[mask] = sum(1 << j for j, p in enumerate(patterns) if not all(p & m for m in placed))
    left, masks = (1 << len(patterns)) - 1, []
    while left:
        best = max(fits, key=lambda m: ((fits[m] & left).bit_count(), -m))
        if not fits[best] & left:
            return []
        masks.append(f"{best:b}"[::-1])
        left &= ~fits[best]
    return masks


@lru_cache(maxsize=None)
def masks_for(length: int) -> tuple[str, ...]:
    """The masks for stretches of ``length`` words: each stretch that agrees in ``SHARE`` percent has a seed."""
    changes = length * (100 - SHARE) // 100
    heaviest: list[str] = []
    for weight in range(2, length - changes + 1):
        masks = _covering(length, changes, weight)
        if not masks or (heaviest and len(masks) > MASKS):
            break
        heaviest = masks
    return tuple(heaviest)


def _at_positions(rows: DataFrame, lengths: list[int], own: Column | None = None) -> DataFrame:
    """A row per position and seed, with the words around; ``own``, if given, is the only length sought."""
    users: dict[str, list[int]] = {}
    for n in lengths:
        for mask in masks_for(n):
            users.setdefault(mask, []).append(n)
    at = F.col("at")

    def key(mask: str) -> Column:
        k = F.xxhash64(F.lit(mask), *(F.get("tokens", at + i) for i, c in enumerate(mask) if c == "1"))
        fits = at + len(mask) <= F.size("tokens")
        return F.when(fits if own is None else fits & own.isin(users[mask]), k)

    last = F.size("tokens") - min(map(len, users), default=1)
    some = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    placed = rows.withColumn("at", F.explode(some))
    keys = F.array(*map(key, users)).cast("array<long>")
    return placed.withColumn("seed", F.explode(keys)).where("seed is not null")


def _around() -> list[Column]:
    left = F.least(F.col("at"), F.lit(PAD))
    return [left.alias("left"), F.slice("tokens", F.col("at") - left + 1, left + STRETCH).alias("words")]


def _best_stretch() -> Column:
    """The most equal words in an aligned stretch, of the length that the item asks for; -1 if it doesn't fit."""
    left = F.least("left", "item_left")
    right = F.least(F.size("words") - F.col("left"), F.size("item_words") - F.col("item_left"))
    equal = F.transform(
        F.sequence(-left, right - 1),
        lambda i: (F.get(F.col("words"), F.col("left") + i) == F.get(F.col("item_words"), F.col("item_left") + i)).cast("int"),
    )

    def best(eq: Column) -> Column:
        counts = F.transform(
            F.sequence(F.lit(1), F.size(eq) - F.col("stretch") + 1),
            lambda i: F.aggregate(F.slice(eq, i, F.col("stretch")), F.lit(0), lambda a, x: a + x),
        )
        return F.when(F.size(eq) >= F.col("stretch"), F.array_max(counts)).otherwise(-1)

    return F.transform(F.array(equal), best)[0]


def _confirmed(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", exact_below: int = 0) -> tuple[DataFrame, DataFrame]:
    """Regions of the benchmark that documents overlap (id, text_key, region, hits, best, stretch), and the items
    (region, item) that have them."""
    items = benchmark.select(F.col(f"`{item_id}`").alias("item"), _tokens(kept_text(f"`{item_text}`")).alias("tokens"))
    items = items.withColumn("n", F.size("tokens")).where(F.col("n") >= MIN_WORDS)
    items = items.withColumn("stretch", F.least(F.col("n"), F.lit(STRETCH)))
    lengths = [r["stretch"] for r in items.select("stretch").distinct().orderBy("stretch").limit(STRETCH).collect()]
    regions = _at_positions(items, lengths, F.col("stretch")).select("seed", "item", "stretch", *_around())
    regions = regions.withColumns({"item_left": F.col("left"), "item_words": F.col("words")})
    region = F.xxhash64("seed", "item_left", "item_words", "stretch")
    regions = regions.select(region.alias("region"), "item", "seed", "item_left", "item_words", "stretch")
    members = written(regions.select("region", "item").distinct(), "benchmark-members")
    regions = written(regions.drop("item").dropDuplicates(["region"]), "benchmark-seeds")
    seeds = regions.select("seed").distinct()
    if seeds.count() <= MAX_BROADCAST_SEEDS:
        seeds = F.broadcast(seeds)
    t = kept_text(f"`{text}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(t).alias("text_key"), _tokens(t).alias("tokens"))
    hits = _at_positions(rows, lengths).join(seeds, "seed", "left_semi").select("id", "text_key", "seed", *_around())
    checked = hits.join(regions, "seed").withColumn("best", _best_stretch())
    found = checked.where(100 * F.col("best") >= SHARE * F.col("stretch"))
    found = found.where((F.col("stretch") >= exact_below) | (F.col("best") == F.col("stretch")))
    found = found.groupBy("id", "text_key", "region").agg(
        F.count("*").alias("hits"), F.max("best").alias("best"), F.max("stretch").alias("stretch")
    )
    return found, members


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    exact_below: int = 0,
) -> DataFrame:
    """One row per overlap of a document with a benchmark item: id, ``text_key``, item, hits, best, stretch.

    A hit is a position at which a document and an item have equal words where a mask asks for them. Around
    each hit the words are aligned, and ``STRETCH`` words in a row (all words of a shorter item) must agree in
    ``SHARE`` percent, and in all if the item has fewer than ``exact_below`` words. The masks of each length of stretch are such that no stretch that would pass is without a
    hit. ``hits`` counts the confirmed hits, ``best`` the equal words of the best stretch.
    ``text_key`` is a hash of the text and tells rows with equal or null ids apart.

    Words around a seed that items share are looked up once and count for each of these items. Null or empty
    texts and items below ``MIN_WORDS`` have no overlaps. Equal rows give one row. Other columns are not read.
    """
    found, members = _confirmed(docs, benchmark, id_col, text, item_id, item_text, exact_below)
    return found.join(members, "region").groupBy(F.col("id").alias(id_col), "text_key", "item").agg(
        F.sum("hits").alias("hits"), F.max("best").alias("best"), F.max("stretch").alias("stretch")
    )


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", exact_below: int = SURE_WORDS, **settings) -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item, with their columns unchanged, whatever they are called."""
    own, key = unused(docs.columns, "found_id"), unused(docs.columns, "found_key")
    found = _confirmed(docs, benchmark, id_col, text, exact_below=exact_below, **settings)[0]
    found = found.select(F.col("id").alias(own), F.col("text_key").alias(key)).distinct()
    same = docs[f"`{id_col}`"].eqNullSafe(F.col(own)) & (F.xxhash64(kept_text(docs[f"`{text}`"])) == F.col(key))
    return docs.join(found, same, "left_anti")
