"""Shards of near equal bytes: sampled splitters, ranges of keys, and subdivision of overfull ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import byte_size, kept_text, unused, written

SHARDS = 24
#: Ranges for each shard, and sampled rows for each range.
RANGES_PER_SHARD = 16
SAMPLES_PER_RANGE = 4
#: A range that holds more than this many times its share is subdivided.
OVERFULL = 3
#: Rounds of subdivision. A range that is left holds few rows, or equal keys, which no splitter can part.
ROUNDS = 4
#: Added to the bytes of each text, for its length in a record file.
RECORD_BYTES = 8

#: Stretches of the hash in the table that finds a range.
CELL_SHIFT = 55
CELLS = 1 << (64 - CELL_SHIFT)

Splitter = tuple[int, int]


def _splitters(keyed: DataFrame, n_ranges: int) -> list[Splitter]:
    """``n_ranges - 1`` quantiles of a sample in which a row's chance is in proportion to its size.

    Each row draws an exponential waiting time at the rate of its size; the shortest waits are the sample.
    It has a fixed number of rows, whatever the data.
    """
    n = n_ranges * SAMPLES_PER_RANGE
    draw = (F.pmod(F.xxhash64(F.lit("draw"), "k1", "k2"), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
    wait = -F.log(draw) / F.col("size")
    sample = keyed.orderBy(wait, "k1", "k2").select("k1", "k2").limit(n).collect()
    keys = sorted((r["k1"], r["k2"]) for r in sample)
    return sorted({keys[len(keys) * i // n_ranges] for i in range(1, n_ranges) if keys})


def _ranged(keyed: DataFrame, splitters: list[Splitter]) -> DataFrame:
    """Adds ``r``, the number of splitters at or below the key.

    A broadcast table names, for each of CELLS stretches of the hash, the splitters inside and how many come
    before. It has a fixed number of rows and holds each splitter once.
    """
    inside: dict[int, list[Splitter]] = {}
    for k in splitters:
        inside.setdefault((k[0] >> CELL_SHIFT) + CELLS // 2, []).append(k)
    rows, before = [], 0
    for cell in range(CELLS):
        keys = inside.get(cell, [])
        rows.append(f"({cell}, {before}, '{' '.join(str(k) for k, _ in keys)}', '{' '.join(str(k) for _, k in keys)}')")
        before += len(keys)
    table = keyed.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(cell, before, s1, s2)")

    def numbers(text: str) -> Column:
        return F.transform(F.array_remove(F.split(text, " "), ""), lambda x: x.cast("long"))

    table = table.select("cell", "before", F.arrays_zip(numbers("s1").alias("k1"), numbers("s2").alias("k2")).alias("splits"))
    cell = F.shiftright("k1", CELL_SHIFT) + CELLS // 2
    k1, k2 = F.col("k1"), F.col("k2")
    passed = F.filter("splits", lambda x: (x["k1"] < k1) | ((x["k1"] == k1) & (x["k2"] <= k2)))
    found = keyed.withColumn("cell", cell.cast("int")).join(F.broadcast(table), "cell")
    return found.withColumn("r", F.col("before") + F.size(passed)).drop("cell", "before", "splits")


def _totals(keyed: DataFrame, splitters: list[Splitter]) -> list[tuple[int, int, int]]:
    """Range, rows and bytes of all ranges that have rows: as many as there are splitters at most."""
    ranged = _ranged(keyed, splitters).groupBy("r").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    return sorted((r["r"], r["n"], r["b"]) for r in ranged.collect())


def _subdivided(keyed: DataFrame, splitters: list[Splitter], n_ranges: int) -> tuple[list[Splitter], list]:
    totals = _totals(keyed, splitters)
    share = sum(b for _, _, b in totals) / n_ranges
    for _ in range(ROUNDS):
        full = [r for r, n, b in totals if n > 1 and b > OVERFULL * share]
        if not full:
            break
        inside = _ranged(keyed, splitters).where(F.col("r").isin(full))
        pieces = sum(int(b // share) + 1 for r, _, b in totals if r in full)
        more = sorted({*splitters, *_splitters(inside, min(pieces + 1, n_ranges))})
        if more == splitters:
            break
        splitters = more
        totals = _totals(keyed, splitters)
    return splitters, totals


def byte_shards(
    docs: DataFrame, n_shards: int = SHARDS, id_col: str = "doc_id", text: str = "text", carried: list[str] | None = None, spread: bool = False
) -> DataFrame:
    """One row per row of ``docs``: id, size, crc32 of the text, shard and slot, by the law ``bytes``.

    With ``carried`` the row has these columns in place of the id; where one of the others is called the same, that
    gets an underscore before its name. With ``spread`` rows that are equal in id and text are numbered, and each
    number goes its own way, so that what a mix repeats is dealt out over the shards.

    Rows are ordered by (hash of the text, id), so that equal texts stand together; a shard is a run of that
    order. A row belongs to the shard in which the middle of its bytes falls, so a shard misses its share by
    less than the largest row at either end, and only a text on such a border lies in two shards. Slots count
    from 0 in that order. No task sorts more than a range of keys.

    A null text counts as an empty one, a null id sorts first. Rows with equal id and text are interchangeable
    and stay in one range. An empty table gives an empty result. Other columns are not read.
    """
    spark, t = docs.sparkSession, kept_text(f"`{text}`")
    kept = [id_col] if carried is None else carried
    keyed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row_columns"),
        F.col(f"`{id_col}`").alias("id"),
        (byte_size(t) + RECORD_BYTES).alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.xxhash64(t).alias("k1"),
        F.coalesce(F.xxhash64(F.col(f"`{id_col}`").cast("string")), F.lit(0)).alias("k2"),
    )
    stored = written(keyed.withColumn("row_id", F.monotonically_increasing_id()), "shard-keys")
    keyed = stored.select("row_id", "id", "size", "text_crc32", "k1", "k2")
    if spread:
        # numbered on keys alone: the carried columns take no part in this shuffle
        copy = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("row_id"))
        keyed = written(keyed.withColumn("k1", F.xxhash64("k1", "k2", copy)), "spread-keys")
    n_ranges = n_shards * RANGES_PER_SHARD
    splitters, totals = _subdivided(keyed, _splitters(keyed, n_ranges), n_ranges)
    total = max(sum(b for _, _, b in totals), 1)
    starts, bytes_before, rows_before = [], 0, 0
    for r, n, b in totals:
        starts.append(f"({r}, {bytes_before}L, {rows_before}L)")
        bytes_before, rows_before = bytes_before + b, rows_before + n
    ahead = spark.sql(f"SELECT * FROM VALUES {', '.join(starts or ['(0, 0L, 0L)'])} AS t(r, bytes_before, rows_before)")
    in_range = Window.partitionBy("r").orderBy("k1", "k2", "id")
    up_to = in_range.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        _ranged(keyed, splitters)
        .withColumn("end", F.sum("size").over(up_to))
        .withColumn("row", F.row_number().over(in_range) - 1)
        .join(F.broadcast(ahead), "r")
        .withColumn("end", F.col("end") + F.col("bytes_before"))
        .withColumn("row", F.col("row") + F.col("rows_before"))
        .withColumn("shard", F.expr(f"cast(least({n_shards - 1}, (2 * end - size) * {n_shards} div (2 * {total}L)) as int)"))
    )
    per_range = placed.groupBy("shard").agg(F.min("row").alias("first_row"))
    found = {
        "size": F.col("size"),
        "text_crc32": F.col("text_crc32"),
        "law": F.lit("bytes"),
        "shard": F.col("shard"),
        "slot": (F.col("row") - F.col("first_row")).cast("long"),
        "grown_shard": F.lit(None).cast("int"),
    }
    named = [c.alias(unused(kept, n)) for n, c in found.items()]
    rows = placed.join(F.broadcast(per_range), "shard")
    if carried is None:
        return rows.select(F.col("id").alias(id_col), *named)
    # ranges are few and hold keys only; the carried columns meet their places in as many tasks as their size asks for
    return rows.select("row_id", *named).join(stored.select("row_id", "row_columns"), "row_id").select(
        *(F.col(f"row_columns.`{c}`").alias(c) for c in kept), *(unused(kept, n) for n in found)
    )
