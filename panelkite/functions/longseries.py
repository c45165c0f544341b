"""Windows of bounded reach over series of any length.

A daily series is bounded by the calendar and fits one window partition. A series of single events or minutes does not, least
of all where ``keys=[]`` makes the whole table one series. Here its rows get their position from one range shuffle and prefix
counts of the ranges, are cut into buckets of equal length, and the last rows of a bucket are copied in front of the next, as
many as the windows look back. Each window then sees its bucket only, so the largest task does not grow with the series.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelkite.session import written

BUCKET_ROWS = 100_000
ID_BITS = 33  # of a row's number within its partition


def positioned(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows with ``__pos``, their place in their series from 0 on; ``order`` should have no ties. Keys must not be NULL.

    Written once in order, so that numbers and counts belong to the same ranges.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    rows = written(ranged.withColumn("__id", F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumn("__part", F.shiftright("__id", ID_BITS))
    # One row per series and range that holds some of it.
    spans = rows.groupBy(*keys, "__part").agg(F.count("*").alias("__rows"), F.min("__id").alias("__first"))
    before = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = spans.select(*keys, "__part", "__first", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    placed = rows.join(starts, [*keys, "__part"])
    return placed.select(*df.columns, (F.col("__start") + F.col("__id") - F.col("__first")).alias("__pos"))


def long_windows(
    df: DataFrame, keys: list[str], order: list[str], columns: Callable[[WindowSpec, Column], dict[str, Column]], reach: int,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """The rows with the columns that ``columns(window, position)`` names.

    ``reach`` is the number of rows that any of them looks back; none may look forward or further back. Lags, differences,
    ratios, rolling statistics and moving averages have such a reach.
    """
    if reach < 0 or bucket_rows < 1:
        raise ValueError("reach must not be negative, and a bucket must hold a row")
    size = max(bucket_rows, reach, 1)
    pos = F.col("__pos")
    own = F.floor(pos / size)
    ahead = F.when((pos % size >= size - reach) & F.lit(reach > 0), F.struct((own + 1).alias("__bucket"), F.lit(True).alias("__copy")))
    places = F.array_compact(F.array(F.struct(own.alias("__bucket"), F.lit(False).alias("__copy")), ahead))
    rows = positioned(df, keys, order).select("*", F.inline(places))
    w = W.partitionBy(*keys, "__bucket").orderBy("__pos")
    made = columns(w, pos)
    out = rows.select(*df.columns, "__copy", *[c.alias(n) for n, c in made.items()])
    return out.filter(~F.col("__copy")).drop("__copy")
