"""Forecast requests: one model, all, an ensemble, or the best per series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkite.functions.keys import attach
from panelkite.models.base import Fitted, check_horizon
from panelkite.models.ensemble import NAME as ENSEMBLE
from panelkite.models.ensemble import ensemble, forecast_summary
from panelkite.models.registry import ALIASES, forecast_all, resolve


def request_forecast(
    fitted: dict[str, Fitted],
    model: str,
    n_days: int,
    level: float = 0.95,
    include_ci: bool = True,
    best: DataFrame | None = None,
    weights: dict[str, float] | None = None,
    newest: DataFrame | None = None,
) -> DataFrame:
    """``model`` is a name, ``all``, ``ensemble``, or ``best`` (with ``best``: keys and model_name per series).

    ``newest`` (keys and last_date) tells where newer data than the models were fitted on ends: the forecasts are those
    of the days after it, the gap counted. Series that it does not name, or not later, go on from their own last day.
    """
    check_horizon(n_days)
    days = n_days + (_gap(fitted, newest) if newest is not None else 0)
    keys = next(iter(fitted.values())).keys
    if model in ("all", ENSEMBLE, "best"):
        frame = forecast_all(fitted, days, level, include_ci, limit=None)
        if newest is not None:
            frame = _after(frame, keys, newest, n_days)
        if model == "all":
            return frame
        if model == ENSEMBLE:
            return ensemble(frame, keys, weights)
        if best is None:
            raise ValueError("no trained models found: pass the best model per series")
        if not keys:
            return frame.filter(F.col("model") == best.select("model_name").scalar())
        choice = best.select(*keys, F.col("model_name").alias("model"))
        return frame.join(choice, [*keys, "model"], "left_semi")
    name = ALIASES.get(model, model)
    held = {f.model: f for f in fitted.values()}
    if name not in held:
        raise ValueError(f"model {model!r} is not loaded: {sorted(held)}")
    frame = resolve(name).forecast(held[name], days, level=level, include_ci=include_ci, limit=None)
    return frame if newest is None else _after(frame, keys, newest, n_days)


def _gap(fitted: dict[str, Fitted], newest: DataFrame) -> int:
    """Days from the last fitted day to the newest one, at most over all series and models."""
    longest = 0
    for f in fitted.values():
        ends = attach(f.series.select(*f.keys, F.col("last_date").alias("__fitted")), newest.select(*f.keys, "last_date"), f.keys)
        longest = max(longest, ends.agg(F.max(F.datediff("last_date", "__fitted"))).first()[0] or 0)
    return longest


def _after(frame: DataFrame, keys: list[str], newest: DataFrame, n_days: int) -> DataFrame:
    """The ``n_days`` days after the newest one of each series, numbered from there."""
    rows = attach(frame, newest.select(*keys, F.col("last_date").alias("__newest")), keys)
    gap = F.datediff(F.col("__newest"), F.date_sub("date", F.col("day_number")))
    rows = rows.withColumn("day_number", F.col("day_number") - F.greatest(F.lit(0), F.coalesce(gap, F.lit(0))))
    return rows.filter(F.col("day_number").between(1, n_days)).select(*frame.columns)


def response(forecasts: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rounded items and the rounded summary per series and model."""
    money = [F.round(c, 2).alias(c) for c in ("predicted", "lower_bound", "upper_bound")]
    items = forecasts.select(*keys, "model", "date", *money)
    summary = forecast_summary(forecasts, [*keys, "model"])
    figures = ("total", "mean", "min", "max", "ci_mean_width")
    return items, summary.select(*keys, "model", "n_days", *[F.round(c, 2).alias(c) for c in figures])
