"""Registered queries of the pipeline operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkite.llm import chat, langid, lengths, linededup, minhash, mixing, packing, pii, quality, repair, spelling, substring, topk
from panelkite.llm.tables import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), Scratch(spark))
    return mixed.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"),
    )


def op2_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k and 2k + 1 answer each other: the even one is chosen."""
    conversations = table(spark, sf_dir, "conversations")
    pair = F.floor(F.col("conv_id") / 2).cast("long")
    out = chat.format_pairs(conversations, pair, F.col("conv_id") % 2 == 0)
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.withColumns({"chosen_mask": spans("chosen_mask"), "rejected_mask": spans("rejected_mask")})


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), Scratch(spark))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Written once, as the sums read the histogram twice: the texts are encoded in one pass.
    histogram = Scratch(spark).write(lengths.length_histogram(table(spark, sf_dir, "documents")), "lengths")
    return lengths.suffix_sums(histogram)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", F.col("q_words").alias("n_words"), F.col("q_word_chars").alias("word_chars"),
        F.col("q_symbols").alias("n_symbols"), F.col("q_dup_lines").alias("n_dup_lines"),
        F.col("q_repeat_words").alias("n_repeat_words"), "base_failed", "kept",
    )


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, Scratch(spark))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"))
    return packed.withColumn("length", F.col("length").cast("long"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents")))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    # Written, as a broadcast of the bitmaps is decided by their size.
    bitmaps = scratch.write(linededup.keep_bitmaps(docs, scratch, min_docs=10), "line-bitmaps")
    kept = linededup.apply_keep(docs, bitmaps)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.vocabulary(table(spark, sf_dir, "documents"))
    return spelling.variants(words, Scratch(spark)).select("word", "form", "root", "n", "n_near", "form_n")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    scratch = Scratch(spark)
    mended = repair.repair(repair.damage(conversations), scratch)
    report = scratch.write(mended.report, "report")
    hashes = repair.hashed(mended.turns).withColumnRenamed("conv_id", "h")
    ids = conversations.select(F.col("conv_id").alias("c")).distinct()
    out = ids.join(report, F.col("c").eqNullSafe(F.col("conv_id")), "left").join(hashes, F.col("c").eqNullSafe(F.col("h")), "left")
    counts = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(
        F.col("c").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_source_mix, op2_preference_pairs, op3_substring_dedup, op4_token_counts, op5_quality_rules, op6_top_k,
        op7_best_fit_packing, op8_language_id, op9_pii, op10_near_duplicates, op11_line_dedup,
        op12_spelling_variants, op13_conversation_repair,
    )
}
