"""Window expressions: lags, ratios, rolling statistics and exponentially weighted means.

Frames are positional (rows, not days). Windows that share a series and its date order are planned
as one Window operator over one exchange, whatever the number of expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelkite.functions.keys import series_window

ROLLING = ("mean", "std", "min", "max", "median", "sum")


def lag(x: Column, k: int, w: WindowSpec) -> Column:
    return F.lag(x, k).over(w)


def diff(x: Column, k: int, w: WindowSpec) -> Column:
    return x - F.lag(x, k).over(w)


def ratio(x: Column, k: int, w: WindowSpec) -> Column:
    """x over its value k rows back, NULL where that is zero."""
    return F.try_divide(x, F.lag(x, k).over(w))


def pct_change(x: Column, k: int, w: WindowSpec) -> Column:
    return ratio(x, k, w) - 1.0


def rolling(x: Column, stat: str, n: int, w: WindowSpec) -> Column:
    """Statistic of the n rows before the current one, over however many of them exist."""
    frame = w.rowsBetween(-n, -1)
    aggregate = {
        "mean": F.avg,
        "std": F.stddev_samp,
        "min": F.min,
        "max": F.max,
        "median": lambda c: F.percentile(c, F.lit(0.5)),
        "sum": F.sum,
    }[stat]
    return aggregate(x).over(frame)


def strict_rolling(x: Column, stat: str, n: int, w: WindowSpec) -> Column:
    """As :func:`rolling`, NULL until the frame holds n values."""
    return F.when(F.count(x).over(w.rowsBetween(-n, -1)) == n, rolling(x, stat, n, w))


def moving_average(x: Column, n: int, w: WindowSpec) -> Column:
    """Mean of the current row and the n-1 before it, NULL until n values exist."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) == n, F.avg(x).over(frame))


def position(w: WindowSpec) -> Column:
    return F.row_number().over(w) - 1


def gap_days(date_col: str, w: WindowSpec) -> Column:
    return F.datediff(F.col(date_col), F.lag(date_col).over(w))


def forward_back_fill(x: Column, w: WindowSpec) -> Column:
    before = F.last(x, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    after = F.first(x, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    return F.coalesce(x, before, after)


def with_ewm(
    df: DataFrame,
    keys: list[str],
    date_col: str,
    value_col: str,
    spans: tuple[int, ...],
    prefix: str | None = None,
) -> DataFrame:
    """Add the exponentially weighted mean of all earlier rows (weights (1-a)^i, a = 2/(span+1)).

    Linear in the number of rows: positions are cut into blocks long enough for a weight to fall
    below double precision across one block. Within a block a running sum of x*(1-a)^-offset gives
    the mean after rescaling and cannot overflow; the block before it adds one carried sum, and
    anything older weighs nothing in double precision.
    """
    prefix = prefix or f"{value_col}_ewm_"
    decay = {s: 1.0 - 2.0 / (s + 1.0) for s in spans}
    w = series_window(keys, date_col)
    # Shifted by one row, so that a row never sees its own value.
    out = df.select("*", (F.row_number().over(w) - 1).alias("__pos"), F.lag(value_col).over(w).alias("__x"))
    for block_len, members in _span_groups(decay):
        out = _block_sums(out, keys, block_len, {s: decay[s] for s in members})
    exprs = []
    for s in spans:
        if decay[s] > 0.0:
            value = F.try_divide(F.col(f"__n{s}"), F.col(f"__d{s}"))
        else:
            value = F.last("__x", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
        exprs.append(value.alias(f"{prefix}{s}"))
    return out.select(*df.columns, *exprs)


def _span_groups(decay: dict[int, float]) -> list[tuple[int, list[int]]]:
    """Spans that can share a block length: long enough for the slowest, short enough for the fastest not to overflow."""
    needed = {s: math.ceil(37.0 / -math.log(d)) for s, d in decay.items() if d > 0.0}
    groups: list[tuple[int, list[int]]] = []
    for s in sorted(needed, key=lambda k: -needed[k]):
        if groups and groups[-1][0] * -math.log(decay[s]) < 600.0:
            groups[-1][1].append(s)
        else:
            groups.append((needed[s], [s]))
    return groups


def _block_sums(df: DataFrame, keys: list[str], block_len: int, decay: dict[int, float]) -> DataFrame:
    """Add the weighted sum and the weight total of all earlier rows for each span."""
    base = df.select(
        "*",
        F.floor(F.col("__pos") / block_len).cast("int").alias("__blk"),
        (F.col("__pos") % block_len).cast("double").alias("__off"),
    )
    inside = W.partitionBy(*keys, "__blk").orderBy("__pos").rowsBetween(W.unboundedPreceding, 0)
    previous = W.partitionBy(*keys).orderBy("__blk").rangeBetween(-1, -1)
    x, off, known = F.col("__x"), F.col("__off"), F.col("__x").isNotNull()
    run, carry, total = [], [], []
    for s, d in decay.items():
        up, to_end = F.pow(F.lit(d), -off), F.pow(F.lit(d), F.lit(block_len - 1.0) - off)
        for part, here in (("n", x), ("d", F.when(known, F.lit(1.0)))):
            run.append(F.sum(here * up).over(inside).alias(f"__r{part}{s}"))
            carry.append(F.sum(here * to_end).over(previous).alias(f"__c{part}{s}"))
            inner = F.coalesce(F.col(f"__r{part}{s}"), F.lit(0.0)) * F.pow(F.lit(d), off)
            older = F.coalesce(F.col(f"__c{part}{s}"), F.lit(0.0)) * F.pow(F.lit(d), off + 1.0)
            total.append((inner + older).alias(f"__{part}{s}"))
    return base.select("*", *run).select("*", *carry).select(*df.columns, *total)
