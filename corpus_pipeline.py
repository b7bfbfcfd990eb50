"""From documents to shards for training: every stage is an operator of ``fleetlens.llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import decontamination, minhash, mixing, quality, sharding
from fleetlens.llm.common import kept_text, unused, written

#: Least similarity of near duplicates in the corpus, in percent.
NEAR = 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass every quality rule."""
    return quality.passing(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id; of equal rows one.

    Texts without words are in no group: each (id, text) of them stays once.
    """
    found = minhash.near_duplicates(docs, similarity=NEAR)
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    least = found.where("root is not null").groupBy("root").agg(F.min(row).alias("row")).select("row.*")
    alone = found.where("root is null").select("doc_id", "text_key").distinct()
    own, wanted, key = (unused(docs.columns, n) for n in ("kept_id", "kept_key", "text_key"))
    kept = least.select("doc_id", "text_key").union(alone).withColumnsRenamed({"doc_id": own, "text_key": wanted})
    keyed = docs.withColumn(key, F.xxhash64(kept_text(docs["text"])))
    same = keyed["doc_id"].eqNullSafe(F.col(own)) & (F.col(key) == F.col(wanted))
    return keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", key]).drop(key)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that share no passage with the benchmark."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them, in its order; one that is taken twice is there twice."""
    return mixing.mixed(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot; what the mix repeats goes to different places."""
    return sharding.byte_shards(docs, carried=docs.columns, spread=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_stage),
    ("minhash near duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The near-duplicate stage rests on hashes that SQL does not have.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a directory; each reads the table that the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
