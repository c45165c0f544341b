"""Mixing sources to target weights, by DataFrame functions only.

Documents get a hash-random key. Within each source the keys are cut into ranges; sums of the ranges and their
prefix sums locate the range where the source's budget ends, and only that range is sorted row by row. Ranges
before it are taken whole, those after it not at all, beyond the whole epochs that the budget holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkite.llm.tables import Scratch, without

WORD = "[^\\x20\\x09-\\x0D]+"
CYCLE = (1.0, 2.0, 3.0)
MOST_EPOCHS = 3
ROWS_PER_RANGE = 2_000
SEED = 7
OWN = (
    "mix_size", "mix_source_size", "mix_target", "mix_taken", "mix_key", "mix_range", "mix_prefix", "cut_source", "source_size",
    "mix_weight", "mix_budget", "mix_epochs", "mix_left", "cut_range", "cut_left", "mix_copy",
)


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def cycle_weights(sources: DataFrame, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """Weights by the rank of the source in code point order, null last, repeating the cycle."""
    rank = F.row_number().over(Window.orderBy(F.col("mix_source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (rank % len(cycle) + 1).cast("int"))
    return sources.withColumn("mix_weight", weight)


def targets(sources: DataFrame, share: float = 1.0, most: int = MOST_EPOCHS) -> DataFrame:
    """Water-filling: each source's part by weight of ``share`` of all words, at most ``most`` times its size.

    Takes one row per source (mix_source, source_size, mix_weight) and adds ``mix_target``. With sources in order
    of cap per weight, those before the first one under the common level are full. Weights must be above 0.
    """
    order = Window.orderBy("mix_cap_ratio", F.col("mix_source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = F.col("source_size") * F.lit(float(most))
    levels = sources.withColumn("mix_cap_ratio", cap / F.col("mix_weight")).withColumns({
        "mix_rest": F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum(cap).over(before), F.lit(0.0)),
        "mix_weights": F.sum("mix_weight").over(onward),
    })
    levels = levels.withColumn("mix_full", F.col("mix_cap_ratio") * F.col("mix_weights") <= F.col("mix_rest"))
    # The first source that is not full fixes the level of all that follow.
    level = F.first(F.when(~F.col("mix_full"), F.struct("mix_rest", "mix_weights")), ignorenulls=True).over(everything)
    return levels.withColumn("mix_level", level).select(
        *sources.columns,
        F.when(F.col("mix_full"), cap)
        .otherwise(F.col("mix_level.mix_rest") * F.col("mix_weight") / F.col("mix_level.mix_weights")).alias("mix_target"),
    )


def mix(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: dict[str | None, float] | None = None, share: float = 1.0, most: int = MOST_EPOCHS,
        seed: int = SEED) -> DataFrame:
    """All columns of ``docs`` with mix_size, mix_source_size, mix_target and mix_taken.

    ``mix_taken`` counts the words the mix takes of a row, repeats included: whole epochs, and in the last epoch
    the rows in order of their key until the source's budget, the rounded target, is used up. The row at the cut
    gives its first words only. A null source is a source of its own, the last in order; null and empty texts have
    no words and are never taken. Rows with the same id share a key and follow each other by size and text; equal
    rows are interchangeable. ``weights`` names the weight (above 0) of each source; without it the cycle 1, 2, 3
    applies. An empty table gives an empty result. Input columns with a name made here are replaced.
    """
    spark = docs.sparkSession
    docs = without(docs, *OWN)
    key = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(str(seed))).cast("binary"))
    base = docs.withColumns({"mix_size": n_words(F.col(text_col).cast("string")), "mix_key": key})
    sized = scratch.write(base.select(F.col(source_col).alias("mix_source"), "mix_size", "mix_key"), "mix-sizes")
    ranges = max(64, -(-sized.count() // ROWS_PER_RANGE))
    place = F.floor(F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("long") * F.lit(ranges) / F.lit(2**32)).cast("long")
    sums = scratch.write(
        sized.groupBy("mix_source", place.alias("mix_range")).agg(F.sum("mix_size").alias("range_size")), "mix-ranges"
    )
    sources = sums.groupBy("mix_source").agg(F.sum("range_size").alias("source_size"))
    if weights is None:
        weighted = cycle_weights(sources)
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "given string, mix_weight double")
        weighted = sources.join(F.broadcast(given), sources.mix_source.eqNullSafe(given.given)).drop("given")
    budget = F.round("mix_target").cast("long")
    goals = targets(weighted, share, most).withColumn("mix_budget", budget)
    goals = goals.withColumns({
        "mix_epochs": F.when(F.col("source_size") > 0, F.floor(F.col("mix_budget") / F.col("source_size"))).otherwise(0).cast("long"),
    }).withColumn("mix_left", F.col("mix_budget") - F.col("mix_epochs") * F.col("source_size"))
    goals = scratch.write(goals, "mix-goals")
    # The range in which a source's rest is used up, and what is left when it begins.
    before = Window.partitionBy("mix_source").orderBy("mix_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("range_start", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    g, s = goals.alias("g"), starts.alias("s")
    cuts = (
        g.join(s, F.col("g.mix_source").eqNullSafe(F.col("s.mix_source"))
               & (F.col("s.range_start") <= F.col("g.mix_left"))
               & (F.col("g.mix_left") < F.col("s.range_start") + F.col("s.range_size")), "left")
        .select("g.*", F.col("s.mix_range").alias("cut_range"), (F.col("g.mix_left") - F.col("s.range_start")).alias("cut_left"))
    )
    cuts = scratch.write(cuts.withColumnRenamed("mix_source", "cut_source"), "mix-cuts")
    scratch.close(cuts)
    # One row per source: small beside the session's broadcast threshold, or joined by its sort otherwise.
    rows = base.withColumn("mix_range", place).join(cuts, F.col(source_col).eqNullSafe(F.col("cut_source")))
    whole = F.col("mix_epochs") * F.col("mix_size")
    at_cut = F.coalesce(F.col("mix_range") == F.col("cut_range"), F.lit(False))
    names = [*docs.columns, "mix_size", F.col("source_size").alias("mix_source_size"), "mix_target"]
    once_more = F.when(F.col("mix_range") < F.coalesce("cut_range", F.lit(0)), F.col("mix_size")).otherwise(0)
    clear = rows.filter(~at_cut).select(*names, (whole + once_more).alias("mix_taken"))
    own = Window.partitionBy("cut_source").orderBy("mix_key", "mix_size", F.xxhash64(text_col))
    prefix = F.sum("mix_size").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("mix_size")
    part = F.greatest(F.lit(0), F.least(F.col("mix_size"), F.col("cut_left") - F.col("mix_prefix")))
    sorted_ = rows.filter(at_cut).withColumn("mix_prefix", prefix).select(*names, (whole + part).alias("mix_taken"))
    return clear.unionByName(sorted_)


def apply_mix(mixed: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """The rows of a mix: each document as often as it is taken whole, and its first words where it is cut."""
    times = F.when(F.col("mix_size") > 0, F.floor(F.col("mix_taken") / F.col("mix_size"))).otherwise(0).cast("int")
    over = F.col("mix_taken") - times * F.col("mix_size")
    copies = F.concat(
        F.array_repeat(F.lit(0).cast("long"), times),
        F.when(over > 0, F.array(over)).otherwise(F.array().cast("array<bigint>")),
    )
    words = F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))
    exploded = mixed.filter(F.col("mix_taken") > 0).withColumn("mix_copy", F.explode(copies))
    cut_text = F.when(F.col("mix_copy") > 0, F.array_join(F.slice(words, F.lit(1), F.col("mix_copy").cast("int")), " "))
    return exploded.withColumn(text_col, F.coalesce(cut_text, F.col(text_col))).select(*columns)
