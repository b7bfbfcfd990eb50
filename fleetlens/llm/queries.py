"""The registered queries of this package, and those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import (
    decontamination,
    hard_negatives,
    importance,
    language,
    main_text,
    minhash,
    mixing,
    pii,
    quality,
    sharding,
    suffix_dedup,
    toxicity,
    urls,
)
from fleetlens.llm.oracle import ORACLE_SQL  # noqa: F401  the same results as SQL, for the entry points


#: Least similarity of near duplicates that op7_minhash is asked for, in percent.
OP7_SIMILARITY = 85


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_spans(_table(spark, sf_dir, "documents"))
    n_spans = F.size("spans").cast("long")
    return found.select("doc_id", "n_bytes", "n_removed", n_spans.alias("n_spans"), "kept_sha256", (n_spans > 0).alias("has_repeats"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    model = language.learn(docs.where("not held_out"))
    found = language.identify(docs, model, ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(_table(spark, sf_dir, "documents"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select("doc_id", *names, F.array_join("failed", ",").alias("failed"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(_table(spark, sf_dir, "documents"), pii.BASE_KINDS + pii.EXTRA_KINDS)
    base_names = [k.name for k in pii.BASE_KINDS]
    base = F.filter("spans", lambda s: s["kind"].isin(base_names))

    def count(name: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")

    return found.select(
        "doc_id", *map(count, base_names), F.sha2(pii.span_text(base).cast("binary"), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans")
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(_table(spark, sf_dir, "documents"))


def page_outcomes(pages: DataFrame) -> DataFrame:
    """Whether the visible text of a page passes as text: few symbols for its words, and not shouted.

    Pages without words have no outcome.
    """
    shown = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    rows = pages.select("url", F.coalesce(shown, F.lit("")).alias("t"))
    words, letters = F.regexp_count("t", F.lit(r"[^\x20\x09-\x0D]+")), F.regexp_count("t", F.lit("[a-z]"))
    odd = F.regexp_count("t", F.lit(quality.SYMBOLS)) * 10 > words
    loud = F.regexp_count("t", F.lit("[A-Z]")) > letters
    return rows.select("url", F.when(words > 0, ~(odd | loud)).alias("good"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return urls.url_filter(pages, page_outcomes(pages)).drop("mean")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(_table(spark, sf_dir, "documents"), similarity=OP7_SIMILARITY)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixture(_table(spark, sf_dir, "documents"), ["doc_id"])
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    labels = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = toxicity.learn(docs, labels, ["low_quality", "toxic"])
    return toxicity.predict(docs, chain)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    found = decontamination.overlaps(docs, benchmark, exact_below=decontamination.SURE_WORDS)
    return found.select("doc_id", F.col("item").alias("item_id"), "hits", "best", "stretch")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return importance.resampled(docs, benchmark, ["doc_id"]).select("doc.doc_id", "n_features", "weight", "score", "rank")


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir, "pages").select("page_id", "url", main_text.main_text(F.col("html")).alias("main"))
    return found.select("page_id", "url", "main.text", "main.n_chars")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=moved)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in [
        op1_suffix_dedup,
        op2_language_id,
        op3_quality_rules,
        op4_pii,
        op5_sharding,
        op6_url_filter,
        op7_minhash,
        op8_mixing,
        op9_toxicity,
        op10_decontamination,
        op11_importance,
        op12_main_text,
        op13_hard_negatives,
    ]
}
