"""Regression metrics as one distributed aggregate over aligned (actual, predicted) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelkite.functions.scalars import non_negative

METRICS = ("mae", "mse", "rmse", "mape", "smape", "r2", "explained_var", "max_error")

# Fixed value: spacing of doubles at 1, the smallest denominator of the trainer's percentage error.
DOUBLE_EPSILON = 2.220446049250313e-16


def align(actual: DataFrame, predicted: DataFrame, keys: list[str], date_col: str = "date") -> DataFrame:
    """Actuals against predictions on (keys, date), not on row position."""
    return actual.join(predicted, [*keys, date_col])


def regression_metrics(
    df: DataFrame, by: list[str], actual: str = "actual", predicted: str = "predicted", epsilon: float = 1e-10
) -> DataFrame:
    """Eight metrics per group. Percentage errors skip actuals within ``epsilon`` of zero."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    e = y - p
    usable = df.filter(y.isNotNull() & p.isNotNull())
    floor = F.greatest((F.abs(y) + F.abs(p)) / 2, F.lit(epsilon))
    n = F.count(F.lit(1))
    mse = F.avg(e * e)
    mape = F.avg(F.when(F.abs(y) > epsilon, F.abs(e / F.nullif(y, F.lit(0.0))))) * 100
    return usable.groupBy(*by).agg(
        n.alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        F.coalesce(mape, F.lit(float("inf"))).alias("mape"),
        (F.avg(F.abs(e) / floor) * 100).alias("smape"),
        (1 - F.sum(e * e) / (F.var_pop(y) * n + epsilon)).alias("r2"),
        (1 - F.var_pop(e) / (F.var_pop(y) + epsilon)).alias("explained_var"),
        F.max(F.abs(e)).alias("max_error"),
    )


def trainer_metrics(
    df: DataFrame, by: list[str], actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """MAPE, MAE and RMSE with predictions clamped at 0 and tiny actuals kept, not skipped."""
    y, p = F.col(actual).cast("double"), non_negative(F.col(predicted).cast("double"))
    usable = df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    e = y - p
    return usable.groupBy(*by).agg(
        (F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(DOUBLE_EPSILON))) * 100).alias("mape"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
    )


def fold_metrics(per_fold: DataFrame, by: list[str]) -> DataFrame:
    """``by, metric, mean, std, min, max`` over folds; the deviation is the population one."""
    long = per_fold.unpivot([*by], list(METRICS), "metric", "value")
    return long.groupBy(*by, "metric").agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


def rank_models(metrics: DataFrame, by: list[str], metric: str = "test_mape") -> DataFrame:
    """1..n per group by the metric, name breaking ties, NULL last."""
    w = W.partitionBy(*by).orderBy(F.asc_nulls_last(metric), "model_name")
    return metrics.withColumn("rank", F.row_number().over(w))


def best_model(metrics: DataFrame, by: list[str], metric: str = "test_mape") -> DataFrame:
    """The row with the smallest metric per group, by an aggregate rather than a sort."""
    rest = [c for c in metrics.columns if c not in by]
    pick = F.min_by(F.struct(*rest), F.struct(metric, "model_name"))
    out = metrics.filter(F.col(metric).isNotNull()).groupBy(*by).agg(pick.alias("b"))
    return out.select(*by, "b.*")


def target_check(metrics: DataFrame, by: list[str], limit: float = 20.0, metric: str = "test_mape") -> DataFrame:
    return metrics.groupBy(*by).agg(
        F.min(metric).alias("best"), (F.min(metric) <= limit).alias("target_met")
    )
