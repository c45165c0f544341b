"""Series-key helpers: windows, and joining per-series statistics back to rows.

Keys identify a series. On a daily panel they must not be NULL (name a missing key first); the
row-level quality and cleaning operators accept NULL keys.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from panelkite.session import written


def series_window(keys: Iterable[str], date_col: str = "date") -> WindowSpec:
    """One series in date order.

    Meant for frames at daily grain, where a series has at most one row per calendar day; a
    partition is therefore bounded by the calendar, however many raw rows went into it.
    """
    return W.partitionBy(*keys).orderBy(date_col)


def whole_series(keys: Iterable[str], date_col: str = "date") -> WindowSpec:
    """The whole series as a frame, with the sort of :func:`series_window` so that both share one
    Window operator."""
    return series_window(keys, date_col).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


SALT_BUCKETS = 32
# Statistics of at most this many bytes, as they lie in memory, are broadcast to row-level frames; larger ones are shuffled.
BROADCAST_BYTES = 64 << 20
ROW_BYTES, FIELD_BYTES = 64, 16


def _renamed(stats: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str], Column]:
    value_cols = [c for c in stats.columns if c not in keys]
    right = stats.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *value_cols)
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    return right, value_cols, condition


def attach(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Add the columns of ``stats`` (one row per series) to every row of ``df``, itself a small summary.

    Without keys ``stats`` is one global-aggregate row and becomes a scalar subquery. With keys it
    is a null-safe equi-join left to the optimizer.
    """
    if not keys:
        value_cols = list(stats.columns)
        packed = stats.select(F.struct(*value_cols).alias("s")).scalar()
        return (
            df.withColumn("__stats", packed)
            .select(*df.columns, *[F.col(f"__stats.{c}").alias(c) for c in value_cols])
        )
    right, value_cols, condition = _renamed(stats, keys)
    return df.join(right, condition, "left").select(*df.columns, *value_cols)


def bytes_held(stats: DataFrame) -> int:
    """An upper estimate of the table in memory: a fixed size per row and field, texts and arrays by their length."""
    size = F.lit(ROW_BYTES + FIELD_BYTES * len(stats.columns))
    for field in stats.schema:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif isinstance(field.dataType, T.ArrayType):
            size = size + FIELD_BYTES * F.coalesce(F.size(field.name), F.lit(0))
    return stats.agg(F.sum(size.cast("long"))).first()[0] or 0


def attach_rows(df: DataFrame, stats: DataFrame, keys: list[str], stored: bool = False) -> DataFrame:
    """As :func:`attach` for row-level frames, where one series may hold much of the data.

    The statistics are written first (unless ``stored`` says they are) and measured. Up to ``BROADCAST_BYTES`` they are broadcast
    and the rows do not move. Beyond that they are copied to every salt and a row meets one copy, so a
    hot series is spread over tasks, and the join's partitioning does not serve a later aggregate by
    the same keys, which leaves adaptive execution free to split what is still skewed.
    """
    if not keys:
        return attach(df, stats, keys)
    stats = stats if stored else written(stats, "stats")
    right, value_cols, condition = _renamed(stats, keys)
    if bytes_held(stats) <= BROADCAST_BYTES:
        return df.join(F.broadcast(right), condition, "left").select(*df.columns, *value_cols)
    # A hash of the row and not a random number: a recomputed task sends its rows the same way.
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALT_BUCKETS)).cast("int"))
    copies = right.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(SALT_BUCKETS - 1))))
    condition = condition & (F.col("__salt") == F.col("__copy"))
    return salted.join(copies, condition, "left").select(*df.columns, *value_cols)


def join_series(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """As :func:`attach` for a daily panel, whose keys are not NULL.

    A plain equi-join on the keys keeps the partitioning of windows and aggregates by the same keys,
    so no row of the panel is shuffled again.
    """
    return df.join(stats, keys, "left") if keys else attach(df, stats, keys)


def first_per(df: DataFrame, by: list[str], order: list[Column], descending: bool = False) -> DataFrame:
    """The first row of each ``by`` group under ``order``.

    A ``min``/``max`` of a struct combines on the map side, so a group holding much of the data
    never travels to one task whole.
    """
    rest = [c for c in df.columns if c not in by]
    packed = F.struct(*[o.alias(f"__o{i}") for i, o in enumerate(order)], *[F.col(c) for c in rest])
    pick = F.max(packed) if descending else F.min(packed)
    out = df.groupBy(*by).agg(pick.alias("__r"))
    return out.select(*[F.col(c) if c in by else F.col(f"__r.{c}").alias(c) for c in df.columns])


def long_form(df: DataFrame, keys: list[str], columns: list[str], kind: str = "double") -> DataFrame:
    """``keys, column, v``: one row per value, all cast to one type."""
    typed = df.select(*keys, *[F.col(c).cast(kind).alias(c) for c in columns])
    return typed.unpivot(keys, columns, "column", "v")


def null_if_nan(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in floating columns, because Spark aggregates skip only NULL."""
    floats = {n for n, t in df.dtypes if t in ("double", "float")}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])
