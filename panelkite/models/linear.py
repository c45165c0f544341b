"""Linear trend with optional weekday effects, ordinary or ridge.

The fit needs only sums per (series, weekday), so it is one map-side combined aggregate: seven rows
per series reach the solver, a vectorised UDF on an eight-by-eight system. Everything else stays in
the JVM.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from panelkite.config import DEFAULT, PanelConfig
from panelkite.functions.keys import join_series, series_window, whole_series
from panelkite.models.base import Fitted, check_horizon, finish, points, robust_sigma

NAME = "linear_trend"
# Default parameters.
DEFAULTS = {"include_dow": True, "regularization": 0.0}


def solve_moments(moments: np.ndarray, include_dow: bool, alpha: float) -> np.ndarray:
    """Intercept, slope and seven weekday effects from per-weekday sums (n, t, tt, y, ty).

    Least squares, or ridge with an unpenalised intercept, on columns scaled to unit population
    deviation. The minimum-norm solution resolves the redundancy of the weekday columns.
    """
    n, t, tt, y, ty = moments.sum(axis=0)
    width = 8 if include_dow else 1
    mean = np.zeros(width)
    second = np.zeros((width, width))
    cross = np.zeros(width)
    mean[0], second[0, 0], cross[0] = t / n, tt / n, ty / n
    if include_dow:
        share = moments[:, 0] / n
        mean[1:] = share
        second[np.arange(1, 8), np.arange(1, 8)] = share
        second[0, 1:] = second[1:, 0] = moments[:, 1] / n
        cross[1:] = moments[:, 3] / n
    cov = second - np.outer(mean, mean)
    target = cross - mean * (y / n)
    scale = np.sqrt(np.clip(np.diag(cov), 0.0, None))
    scale[scale < 1e-12] = 1.0
    gram = cov / np.outer(scale, scale)
    rhs = target / scale
    if alpha > 0:
        beta = np.linalg.solve(gram + np.eye(width) * (alpha / n), rhs)
    else:
        beta = np.linalg.pinv(gram, rcond=1e-10, hermitian=True) @ rhs
    beta = beta / scale
    out = np.zeros(9)
    out[0] = y / n - mean @ beta
    out[1:1 + width] = beta
    return out


@F.pandas_udf(ArrayType(DoubleType()))
def _solve(moments: pd.Series, include_dow: pd.Series, alpha: pd.Series) -> pd.Series:
    return pd.Series([
        solve_moments(np.asarray(m, float).reshape(7, 5), bool(d), float(a))
        for m, d, a in zip(moments, include_dow, alpha)
    ])


def _rows(df: DataFrame, keys: list[str], cfg: PanelConfig) -> DataFrame:
    w = series_window(keys, cfg.date_col)
    return df.filter(F.col(cfg.target_col).isNotNull()).select(
        *keys,
        F.col(cfg.date_col).alias("date"),
        (F.row_number().over(w) - 1).cast("double").alias("t"),
        F.col(cfg.target_col).cast("double").alias("y"),
        F.weekday(cfg.date_col).alias("dow"),
    )


def moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per series: count, last date, and thirty-five sums in weekday order."""
    t, y, dow = F.col("t"), F.col("y"), F.col("dow")
    cells = []
    for i in range(7):
        here = dow == i
        for v in (F.lit(1.0), t, t * t, y, t * y):
            cells.append(F.coalesce(F.sum(F.when(here, v)), F.lit(0.0)))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_train"), F.max("date").alias("last_date"), F.array(*cells).alias("__m")
    )


def line(coef: Column, t: Column, dow: Column) -> Column:
    return coef[0] + coef[1] * t + F.element_at(coef, dow + 3)


def fit(
    df: DataFrame, keys: list[str], params: dict[str, Any] | None = None, cfg: PanelConfig = DEFAULT,
    per_series: DataFrame | None = None,
) -> Fitted:
    """Coefficients per series, the robust residual deviation and the in-sample error.

    ``per_series`` (``keys, params`` as JSON) overrides ``params`` for the series it names.
    """
    p = DEFAULTS | (params or {})
    rows = _rows(df, keys, cfg)
    dow, alpha = F.lit(bool(p["include_dow"])), F.lit(float(p["regularization"]))
    summed = moments(rows, keys)
    if per_series is not None:
        summed = join_series(summed, per_series.select(*keys, "params"), keys)
        own = F.from_json("params", "include_dow boolean, regularization double")
        dow, alpha = F.coalesce(own["include_dow"], dow), F.coalesce(own["regularization"], alpha)
    solved = summed.select(*keys, "n_train", "last_date", _solve("__m", dow, alpha).alias("coef"))
    residual = F.col("y") - line(F.col("coef"), F.col("t"), F.col("dow"))
    fitted = join_series(rows, solved, keys).select(*keys, "n_train", "last_date", "coef", residual.alias("residual"))
    return Fitted(NAME, keys, p, robust_sigma(fitted, keys, carry=("n_train", "last_date", "coef")))


def in_sample(df: DataFrame, fitted: Fitted, cfg: PanelConfig = DEFAULT) -> DataFrame:
    """``keys, date, actual, predicted`` on the training rows."""
    rows = join_series(_rows(df, fitted.keys, cfg), fitted.series.select(*fitted.keys, "coef"), fitted.keys)
    return rows.select(
        *fitted.keys, "date", F.col("y").alias("actual"),
        line(F.col("coef"), F.col("t"), F.col("dow")).alias("predicted"),
    )


def forecast(
    fitted: Fitted, n_days: int, level: float = 0.95, include_ci: bool = True, limit: int | None = 365
) -> DataFrame:
    def value(i: Column, date: Column) -> dict[str, Column]:
        t = (F.col("n_train") + i - 1).cast("double")
        return {"predicted": line(F.col("coef"), t, F.weekday(date))}

    return finish(fitted.series, fitted.keys, NAME, points(check_horizon(n_days, limit), value), level, include_ci)


def score_candidates(
    df: DataFrame, keys: list[str], candidates: list[dict[str, Any]], n_folds: int, cfg: PanelConfig = DEFAULT
) -> DataFrame:
    """``keys, fold, trial, mape`` of every candidate on the test block of every walk-forward fold.

    The sums are taken once per block of rows; an expanding training window is the sum of its blocks, so neither folds nor
    candidates read the rows again.
    """
    d = cfg.date_col
    rows = _rows(df, keys, cfg).withColumn("n", F.count(F.lit(1)).over(whole_series(keys, "date")))
    least = F.floor(F.col("n") / 2)
    size = F.floor((F.col("n") - least) / n_folds)
    block = F.when(F.col("t") < least, F.lit(0)).otherwise(F.floor(F.try_divide(F.col("t") - least, size)) + 1).cast("int")
    rows = rows.withColumn("block", block).filter((size > 0) & (F.col("block") <= n_folds))
    by_block = moments(rows, [*keys, "block"]).filter(F.col("block") < n_folds)
    sums = by_block.select("*", F.explode(F.sequence("block", F.lit(n_folds - 1))).alias("fold")).groupBy(*keys, "fold").agg(
        F.sum("n_train").alias("n_train"), F.max("last_date").alias("last_date"),
        F.array(*[F.sum(F.col("__m")[i]) for i in range(35)]).alias("__m"))
    trials = F.array(*[
        F.struct(
            F.lit(i).alias("trial"), F.lit(bool(c["include_dow"])).alias("include_dow"),
            F.lit(float(c["regularization"])).alias("alpha"),
        )
        for i, c in enumerate(DEFAULTS | c for c in candidates)
    ])
    solved = sums.select("*", F.explode(trials).alias("c")).select(
        *keys, "fold", "n_train", "last_date", "c.trial", _solve("__m", F.col("c.include_dow"), F.col("c.alpha")).alias("coef"))
    packed = solved.groupBy(*keys, "fold").agg(
        F.first("n_train").alias("n_train"), F.first("last_date").alias("last_date"),
        F.collect_list(F.struct("trial", "coef")).alias("models"))
    tested = rows.filter("block > 0").select(*keys, (F.col("block") - 1).alias("fold"), F.col("date").alias(d), "y")
    tested = join_series(tested, packed, [*keys, "fold"])
    t = (F.col("n_train") + F.datediff(d, "last_date") - 1).cast("double")
    scored = tested.select(*keys, "fold", "y", t.alias("t"), F.weekday(d).alias("dow"), F.inline("models"))
    predicted = F.greatest(line(F.col("coef"), F.col("t"), F.col("dow")), F.lit(0.0))
    error = F.abs(F.try_divide(F.col("y") - predicted, F.col("y")))
    return scored.groupBy(*keys, "fold", "trial").agg((F.avg(error) * 100).alias("mape"))
