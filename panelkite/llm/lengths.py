"""Exact histogram of encoded lengths, and what its suffix sums answer for every context limit."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkite.llm.textcodes import chunks
from panelkite.llm.tokens import TEXT_BYTES, Encoder, default_path

BLOCK = 1024  # lengths per block of the two-level sums


def token_lengths(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """(length, n_docs) for each batch: partial counts, combined by ``length_histogram``."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in chunks(batches, "text", TEXT_BYTES):
            _, offsets = encoder.encode(batch.column("text").to_pylist())
            length, n = np.unique(np.diff(offsets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(length, pa.int64()), pa.array(n, pa.int64())], names=["length", "n_docs"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "length bigint, n_docs bigint")


def length_histogram(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """(length, n_docs): how many documents encode to each number of tokens. Null and empty texts have 0 tokens.

    Repeated rows count each time; an empty table gives an empty histogram.
    """
    return token_lengths(docs, text_col, path).groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length as a context limit: documents and tokens at or above it, and the total cut to it.

    Columns: context_limit, n_docs, docs_over, docs_at_least, tokens_at_least, truncated_total, total_docs,
    total_tokens, share_within. Sums go block by block, so no window holds all lengths.
    """
    rows = histogram.select(
        F.col("length").alias("context_limit"), "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"),
        F.floor(F.col("length") / BLOCK).alias("block"),
    )
    totals = rows.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("n_tokens").alias("block_tokens"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = totals.select(
        "block",
        F.coalesce(F.sum("block_docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("block_tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("block_docs").over(everything).alias("total_docs"),
        F.sum("block_tokens").over(everything).alias("total_tokens"),
    )
    own = Window.partitionBy("block").orderBy(F.desc("context_limit")).rowsBetween(Window.unboundedPreceding, 0)
    out = (
        rows.withColumn("docs_in", F.sum("n_docs").over(own)).withColumn("tokens_in", F.sum("n_tokens").over(own))
        .join(blocks, "block")
        .withColumn("docs_at_least", F.col("docs_in") + F.col("docs_above"))
        .withColumn("tokens_at_least", F.col("tokens_in") + F.col("tokens_above"))
    )
    return out.select(
        "context_limit", "n_docs", (F.col("docs_at_least") - F.col("n_docs")).alias("docs_over"), "docs_at_least",
        "tokens_at_least",
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("context_limit") * F.col("docs_at_least")).alias("truncated_total"),
        "total_docs", "total_tokens",
        ((F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("total_docs")).alias("share_within"),
    )


def at_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """Documents over each given limit, tokens kept when cut to it, and tokens lost."""
    spark = sums.sparkSession
    wanted = spark.createDataFrame([(int(x),) for x in limits], "context_limit bigint")
    # The next length above a limit holds all that is over it.
    over = F.col("s.context_limit") > F.col("w.context_limit")
    return (
        wanted.alias("w").join(sums.alias("s"), over, "left")
        .groupBy(F.col("w.context_limit").alias("context_limit"))
        .agg(F.min_by(F.struct("s.docs_at_least", "s.tokens_at_least"), F.col("s.context_limit")).alias("top"))
        .join(F.broadcast(sums.agg(F.max("total_tokens").alias("total_tokens"))))
        .select(
            "context_limit", F.coalesce("top.docs_at_least", F.lit(0)).alias("docs_over"),
            (F.coalesce("total_tokens", F.lit(0)) - F.coalesce("top.tokens_at_least", F.lit(0))
             + F.col("context_limit") * F.coalesce("top.docs_at_least", F.lit(0))).alias("truncated_total"),
        )
    )


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """The smallest length that at least each share of the documents does not exceed."""
    wanted = sums.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    within = F.col("total_docs") - F.col("docs_over") >= F.col("share") * F.col("total_docs")
    return wanted.join(sums, within, "left").groupBy("share").agg(F.min("context_limit").alias("length"))
