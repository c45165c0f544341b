"""Model names, their fit and forecast functions, and their search spaces."""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce
from typing import Any

from pyspark.sql import DataFrame

from panelkite.config import DEFAULT, PanelConfig
from panelkite.models import arima, decomposable, linear, trees
from panelkite.models.base import Fitted


@dataclass(frozen=True)
class Model:
    name: str
    fit: Callable[..., Fitted]
    forecast: Callable[..., DataFrame]
    defaults: dict[str, Any]
    # parameter -> ("int" | "float" | "log", low, high) or a list of choices
    space: dict[str, Any]
    native_ci: bool = False


# The ranges and choices of the search spaces.
MODELS: dict[str, Model] = {
    linear.NAME: Model(
        linear.NAME, linear.fit, linear.forecast, linear.DEFAULTS,
        {"include_dow": [True, False], "regularization": ("float", 0.0, 100.0)},
    ),
    trees.BOOSTED: Model(
        trees.BOOSTED, partial(trees.fit, model=trees.BOOSTED), trees.forecast, trees.DEFAULTS[trees.BOOSTED],
        {
            "n_estimators": ("int", 50, 300), "max_depth": ("int", 3, 10), "learning_rate": ("float", 0.01, 0.3),
            "min_child_weight": ("int", 1, 10), "subsample": ("float", 0.6, 1.0), "colsample_bytree": ("float", 0.6, 1.0),
        },
    ),
    trees.FOREST: Model(
        trees.FOREST, partial(trees.fit, model=trees.FOREST), trees.forecast, trees.DEFAULTS[trees.FOREST],
        {
            "n_estimators": ("int", 50, 300), "max_depth": ("int", 5, 20), "min_samples_split": ("int", 2, 20),
            "min_samples_leaf": ("int", 1, 5), "max_features": ["sqrt", "log2", "all"],
        },
    ),
    decomposable.NAME: Model(
        decomposable.NAME, decomposable.fit, decomposable.forecast, decomposable.DEFAULTS,
        {
            "changepoint": ("log", 0.001, 0.5), "seasonality": ("float", 0.1, 20.0),
            "mode": ["additive", "multiplicative"], "yearly": [True, False], "weekly": [True, False],
        },
        native_ci=True,
    ),
    arima.NAME: Model(
        arima.NAME, arima.fit, arima.forecast, arima.DEFAULTS,
        {
            "p": ("int", 0, 2), "d": ("int", 0, 1), "q": ("int", 0, 2), "P": ("int", 0, 1), "D": ("int", 0, 1),
            "Q": ("int", 0, 1), "trend": ["n", "c", "t"],
        },
        native_ci=True,
    ),
}

# Names that users of the individual forecasting libraries know.
ALIASES = {"xgboost": trees.BOOSTED, "prophet": decomposable.NAME, "sarima": arima.NAME}


def resolve(name: str) -> Model:
    key = ALIASES.get(name, name)
    if key not in MODELS:
        raise ValueError(f"unknown model {name!r}: choose from {sorted(MODELS)}")
    return MODELS[key]


def sample_params(model: Model, n: int, seed: int = 42) -> list[dict[str, Any]]:
    """The defaults first, then n-1 seeded random draws from the search space."""
    rng = random.Random(seed)
    out: list[dict[str, Any]] = [{k: model.defaults[k] for k in model.space}]
    while len(out) < n:
        draw: dict[str, Any] = {}
        for name, spec in model.space.items():
            if isinstance(spec, list):
                draw[name] = rng.choice(spec)
            elif spec[0] == "int":
                draw[name] = rng.randint(spec[1], spec[2])
            elif spec[0] == "log":
                draw[name] = spec[1] * (spec[2] / spec[1]) ** rng.random()
            else:
                draw[name] = rng.uniform(spec[1], spec[2])
        out.append(draw)
    return out[:n]


def fit_models(
    df: DataFrame, keys: list[str], names: list[str] | None = None, params: dict[str, dict[str, Any]] | None = None,
    cfg: PanelConfig = DEFAULT,
) -> dict[str, Fitted]:
    params = params or {}
    return {n: resolve(n).fit(df, keys, params=params.get(n), cfg=cfg) for n in (names or list(MODELS))}


def forecast_all(
    fitted: dict[str, Fitted], n_days: int, level: float = 0.95, include_ci: bool = True, limit: int | None = 365
) -> DataFrame:
    """The long frame of all models: ``keys, model, date, day_number, predicted, lower_bound, upper_bound``."""
    parts = [resolve(f.model).forecast(f, n_days, level=level, include_ci=include_ci, limit=limit) for f in fitted.values()]
    return reduce(DataFrame.unionByName, parts)
