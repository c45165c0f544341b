"""Weighted mean of model forecasts, aligned on (keys, date) in one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = "ensemble"


def ensemble(forecasts: DataFrame, keys: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """Predictions and both bounds averaged with normalised weights; a model without a weight counts 0.

    The default is equal weights. The weight table is a literal map, so nothing is joined.
    """
    if weights is None:
        weight = F.lit(1.0)
    else:
        if sum(weights.values()) <= 0 or min(weights.values()) < 0:
            raise ValueError("weights must be non-negative with a positive sum")
        table = F.create_map(*[F.lit(v) for m, w in weights.items() for v in (m, float(w))])
        weight = F.coalesce(F.try_element_at(table, F.col("model")), F.lit(0.0))
    weighted = forecasts.withColumn("__w", weight)
    mean = lambda c: F.try_divide(
        F.sum(F.col("__w") * F.col(c)), F.sum(F.when(F.col(c).isNotNull(), F.col("__w")))
    )
    return weighted.groupBy(*keys, "date", "day_number").agg(
        *[mean(c).alias(c) for c in ("predicted", "lower_bound", "upper_bound")]
    ).select(*keys, F.lit(NAME).alias("model"), "date", "day_number", "predicted", "lower_bound", "upper_bound")


def forecast_summary(forecasts: DataFrame, by: list[str]) -> DataFrame:
    """Total, mean, range and mean interval width per group."""
    p = "predicted"
    return forecasts.groupBy(*by).agg(
        F.count("*").alias("n_days"),
        F.sum(p).alias("total"),
        F.avg(p).alias("mean"),
        F.min(p).alias("min"),
        F.max(p).alias("max"),
        F.avg(F.col("upper_bound") - F.col("lower_bound")).alias("ci_mean_width"),
    )
