"""Exact, linearly interpolated quantiles of groups of any size.

Spark's ``percentile`` keeps a value-to-count map per group in one task. That is right for a series
at daily grain, whose size the calendar bounds, and wrong for raw rows, where one group may hold a
third of the data. Here a sketch only narrows down where a quantile lies; the answer itself comes
from exact counts:

1. ``percentile_approx`` gives a narrow value bracket around each wanted rank;
2. one pass counts the rows below and inside each bracket, and a bracket that misses its rank is
   widened to the whole range, so that a poor sketch costs time and not correctness;
3. the rows inside are combined to (value, count) on the map side, cut into ranges of values and ranked
   range by range, so that no task gets a whole group even where a bracket was widened.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelkite.functions.keys import attach, attach_rows, long_form
from panelkite.session import written


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    columns: list[str],
    probs: tuple[float, ...] = (0.25, 0.5, 0.75),
    accuracy: int = 10_000,
) -> DataFrame:
    """Tidy rows ``keys, column, prob, value``; NULL and NaN values are ignored.

    A group without values gives no row. ``df`` is scanned three times, and the passes run when the
    function is called; what they leave, a few values per group and the counted values inside the brackets, is kept
    in the shared folder.
    """
    long = long_form(df, keys, columns).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    ids = [*keys, "column"]
    slack = 2.0 / accuracy
    edges: list[float] = []
    for p in probs:
        edges += [max(0.0, p - slack), min(1.0, p + slack)]
    sketch = long.groupBy(*ids).agg(
        F.count("*").alias("n"),
        F.min("v").alias("v_min"),
        F.max("v").alias("v_max"),
        F.percentile_approx("v", edges, accuracy).alias("e"),
    )
    sketch = written(sketch, "sketch")
    counts = (
        attach_rows(long, sketch.select(*ids, "e"), ids, stored=True)
        .groupBy(*ids)
        .agg(
            *[F.count_if(F.col("v") < F.col("e")[2 * i]).alias(f"b{i}") for i in range(len(probs))],
            *[F.count_if(F.col("v") <= F.col("e")[2 * i + 1]).alias(f"u{i}") for i in range(len(probs))],
        )
    )
    bounds = attach(sketch, counts, ids).select(*ids, "n", *_brackets(probs))
    rows = attach_rows(long, bounds, ids)
    hits = [F.col("v").between(F.col(f"lo{i}"), F.col(f"hi{i}")) for i in range(len(probs))]
    # A plain filter first: nearly every row is in no bracket and ends here, inside generated code.
    near = rows.filter(reduce(lambda x, y: x | y, hits))
    tags = F.array_compact(F.array(*[F.when(h, _target(i, p)) for i, (h, p) in enumerate(zip(hits, probs))]))
    inside = (
        near.select(*ids, "v", F.explode(tags).alias("b"))
        .groupBy(*ids, F.col("b.prob").alias("prob"), F.col("b.rank").alias("rank"), F.col("b.below").alias("below"), "v")
        .agg(F.count("*").alias("c"))
    )
    ranked = _running(inside, [*ids, "prob"])
    rank = F.col("rank")
    picked = ranked.groupBy(*ids, "prob").agg(
        F.min(F.when(F.col("upto") > F.floor(rank), F.col("v"))).alias("x0"),
        F.min(F.when(F.col("upto") > F.ceil(rank), F.col("v"))).alias("x1"),
        F.first(rank - F.floor(rank)).alias("w"),
    )
    return picked.select(*ids, "prob", (F.col("x0") + F.col("w") * (F.col("x1") - F.col("x0"))).alias("value"))


def _running(inside: DataFrame, by: list[str]) -> DataFrame:
    """``inside`` with ``upto``: the rows of its group up to each value, those below the bracket included.

    Groups and values are cut into ranges of equal size, written so that a range stays what it is. Sums of the ranges
    give what lies before each, and rows are only put in order within a range, however many a group has.
    """
    spark = inside.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = inside.repartitionByRange(parts, *by, "v").withColumn("__part", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    sums = dealt.groupBy(*by, "__part").agg(F.sum("c").alias("__own"))
    earlier = W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*by, "__part", F.coalesce(F.sum("__own").over(earlier), F.lit(0)).alias("__before"))
    own = W.partitionBy(*by, "__part").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    summed = dealt.withColumn("__upto", F.sum("c").over(own))
    return attach(summed, starts, [*by, "__part"]).withColumn("upto", F.col("below") + F.col("__before") + F.col("__upto"))


def _rank(p: float) -> Column:
    return (F.col("n") - 1) * F.lit(p)


def _brackets(probs: tuple[float, ...]) -> list[Column]:
    """Bounds and the count below them; the whole range where a bracket misses its rank."""
    out = []
    for i, p in enumerate(probs):
        sound = (F.floor(_rank(p)) >= F.col(f"b{i}")) & (F.ceil(_rank(p)) < F.col(f"u{i}"))
        out.append(F.when(sound, F.col("e")[2 * i]).otherwise(F.col("v_min")).alias(f"lo{i}"))
        out.append(F.when(sound, F.col("e")[2 * i + 1]).otherwise(F.col("v_max")).alias(f"hi{i}"))
        out.append(F.when(sound, F.col(f"b{i}")).otherwise(F.lit(0).cast("long")).alias(f"below{i}"))
    return out


def _target(i: int, p: float) -> Column:
    return F.struct(F.lit(p).alias("prob"), _rank(p).alias("rank"), F.col(f"below{i}").alias("below"))


def wide_quantiles(quantiles: DataFrame, keys: list[str], names: dict[float, str]) -> DataFrame:
    """One row per (keys, column) with a column per probability."""
    return quantiles.groupBy(*keys, "column").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for p, n in names.items()]
    )
