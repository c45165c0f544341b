"""Trend with changepoints plus Fourier seasonality plus a holiday effect, by penalised least squares.

A published decomposable model, re-aimed: hinge terms at up to 25 changepoints over the first 80 % of
the history, ten yearly and three weekly harmonics, a holiday flag. Changepoints have a sparse (Laplace)
prior, solved on the normal equations by an active set, so unused ones are exactly 0; the other terms have
normal priors. The multiplicative mode is a fit of log(y); a series with a value at or below 0 has no
logarithm and is fitted additively, which its state says in ``mode``.

Intervals are quantiles of simulated futures: changepoints go on at the rate and size of the fitted ones,
so intervals widen with the horizon. A series draws from a seed of its own keys, so the result does not
depend on how the series are partitioned.

One series, bounded by the calendar, is one small linear solve inside a grouped Arrow kernel. The
forecast runs on one state row per series.
"""

from __future__ import annotations

import json
import zlib
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkite.config import DEFAULT, PanelConfig
from panelkite.functions.keys import join_series
from panelkite.models.base import Fitted, check_horizon, finish, points

NAME = "decomposable"
# Default parameters.
DEFAULTS = {"changepoint": 0.05, "seasonality": 10.0, "mode": "multiplicative", "yearly": True, "weekly": True}

# The published defaults of the decomposable model.
N_CHANGEPOINTS, CHANGEPOINT_RANGE, YEARLY_ORDER, WEEKLY_ORDER = 25, 0.8, 10, 3
YEAR, WEEK = 365.25, 7.0
SAMPLES = 1000

STATE = T.StructType([
    T.StructField("n_train", T.LongType()),
    T.StructField("last_date", T.DateType()),
    T.StructField("first_day", T.DoubleType()),
    T.StructField("span", T.DoubleType()),
    T.StructField("y_scale", T.DoubleType()),
    T.StructField("is_log", T.BooleanType()),
    T.StructField("mode", T.StringType()),
    T.StructField("yearly", T.BooleanType()),
    T.StructField("weekly", T.BooleanType()),
    T.StructField("changepoints", T.ArrayType(T.DoubleType())),
    T.StructField("coef", T.ArrayType(T.DoubleType())),
    T.StructField("holiday", T.DoubleType()),
    T.StructField("residual_std", T.DoubleType()),
    T.StructField("train_mape", T.DoubleType()),
    T.StructField("train_mae", T.DoubleType()),
    T.StructField("train_rmse", T.DoubleType()),
])


def design(day: np.ndarray, first: float, span: float, cps: np.ndarray, yearly: bool, weekly: bool) -> np.ndarray:
    t = (day - first) / span
    cols = [np.ones_like(t), t, *np.maximum(t[None, :] - cps[:, None], 0.0)]
    for use, period, order in ((yearly, YEAR, YEARLY_ORDER), (weekly, WEEK, WEEKLY_ORDER)):
        for k in range(1, order + 1) if use else ():
            angle = 2 * np.pi * k * day / period
            cols += [np.sin(angle), np.cos(angle)]
    return np.column_stack(cols)


def sparse_minimum(h: np.ndarray, q: np.ndarray, weight: float, steps: int = 1_000) -> np.ndarray:
    """The least point of d'hd/2 - q'd + weight * sum|d|.

    Terms enter one at a time, the one with the steepest gradient first. With the signs of the terms in use the minimum is a
    linear solve; on the way there the best point at which a term passes 0 is taken, and such a term leaves. The value falls
    with every step, so no set of signs comes twice. Hinges are too alike for plain coordinate steps to settle.
    """
    d, sign = np.zeros(len(q)), np.zeros(len(q))
    free = np.diag(h) > 1e-12 * max(float(np.diag(h).max(initial=0.0)), 1e-300)

    def value(x: np.ndarray) -> float:
        return float(0.5 * x @ h @ x - q @ x + weight * np.abs(x).sum())

    settled = True
    for _ in range(steps):
        if settled:
            pull = np.where(free & (d == 0), np.abs(q - h @ d), 0.0)
            k = int(np.argmax(pull)) if len(pull) else 0
            if not len(pull) or pull[k] <= weight * (1 + 1e-9):
                break
            sign[k] = np.sign((q - h @ d)[k])
        used = np.flatnonzero(sign)
        goal = np.zeros(len(q))
        goal[used] = np.linalg.lstsq(h[np.ix_(used, used)], q[used] - weight * sign[used], rcond=None)[0]
        way = goal - d
        with np.errstate(divide="ignore", invalid="ignore"):
            turns = np.where((d != 0) & (d * goal < 0), -d / way, np.inf)
        points = [d + t * way for t in sorted(turns[turns < 1])] + [goal]
        for point, t in zip(points, sorted(turns[turns < 1])):
            point[turns == t] = 0.0
        before, values = value(d), [value(p) for p in points]
        best = int(np.argmin(values))
        if values[best] >= before - 1e-14 * abs(before):
            break
        settled = best == len(points) - 1 and (np.sign(goal[used]) == sign[used]).all()
        d = points[best]
        sign = np.sign(d)
    return d


def penalised(gram: np.ndarray, rhs: np.ndarray, ridge: np.ndarray, sparse: slice, weight: float) -> np.ndarray:
    """Coefficients with the ridge on the smooth terms and an absolute penalty on the sparse ones.

    For given sparse terms the smooth ones have a closed form, which leaves a small problem in the sparse ones.
    """
    is_sparse = np.zeros(len(rhs), bool)
    is_sparse[sparse] = True
    a, b = np.flatnonzero(~is_sparse), np.flatnonzero(is_sparse)
    solved = np.linalg.solve(gram[np.ix_(a, a)] + np.diag(ridge[a] + 1e-10), np.column_stack([gram[np.ix_(a, b)], rhs[a]]))
    cross, plain = solved[:, :-1], solved[:, -1]
    beta = np.zeros(len(rhs))
    beta[b] = sparse_minimum(gram[np.ix_(b, b)] - gram[np.ix_(b, a)] @ cross, rhs[b] - gram[np.ix_(b, a)] @ plain, weight)
    beta[a] = plain - cross @ beta[b]
    return beta


def fit_arrays(day: np.ndarray, y: np.ndarray, holiday: np.ndarray, p: dict[str, Any]) -> dict[str, Any]:
    n = len(y)
    first, span = float(day[0]), float(max(day[-1] - day[0], 1.0))
    is_log = p["mode"] == "multiplicative" and bool((y > 0).all())
    target = np.log(y) if is_log else y
    scale = 1.0 if is_log else float(max(np.abs(y).max(), 1e-12))
    target = target / scale
    n_cp = min(N_CHANGEPOINTS, max(int(n * CHANGEPOINT_RANGE) - 1, 0))
    at = np.linspace(0, int(n * CHANGEPOINT_RANGE) - 1, n_cp + 1)[1:].round().astype(int) if n_cp else np.array([], int)
    cps = (day[at] - first) / span
    x = np.column_stack([design(day, first, span, cps, p["yearly"], p["weekly"]), holiday])
    prior = np.full(x.shape[1], 1.0 / p["seasonality"] ** 2)
    prior[:2] = 1.0 / 25.0
    prior[0] = 1e-8
    gram, rhs, noise = x.T @ x, x.T @ target, float(target.var())
    for _ in range(3):
        beta = penalised(gram, rhs, noise * prior, slice(2, 2 + n_cp), noise / p["changepoint"])
        resid = target - x @ beta
        noise = float(max(resid.var(), 1e-12))
    if n < 2:  # one value says nothing about trend or season: it is the level
        beta = np.zeros(x.shape[1])
        beta[0] = target[0]
        resid = target - x @ beta
    fitted = x @ beta
    natural = np.maximum(np.exp(fitted) if is_log else fitted * scale, 0.0)
    err = np.abs(y - natural)
    dof = max(n - 2, 1)
    return {
        "first_day": first, "span": span, "y_scale": scale, "is_log": is_log,
        "mode": "multiplicative" if is_log else "additive" if p["mode"] != "multiplicative" else "additive, as a value is not positive",
        "yearly": bool(p["yearly"]),
        "weekly": bool(p["weekly"]), "changepoints": cps, "coef": beta[:-1], "holiday": float(beta[-1]),
        "residual_std": float(np.sqrt((resid ** 2).sum() / dof)),
        "train_mape": float((err / np.maximum(np.abs(y), np.finfo(float).eps)).mean() * 100),
        "train_mae": float(err.mean()), "train_rmse": float(np.sqrt((err ** 2).mean())),
    }


def predict_arrays(s: dict[str, Any], day: np.ndarray) -> np.ndarray:
    """Values on the fitting scale (log or scaled), without holiday effects."""
    x = design(day, s["first_day"], s["span"], np.asarray(s["changepoints"], float), s["yearly"], s["weekly"])
    return x @ np.asarray(s["coef"], float)


def to_natural(s: dict[str, Any], value: np.ndarray) -> np.ndarray:
    return np.exp(np.minimum(value, 700.0)) if s["is_log"] else value * s["y_scale"]


def simulated_bounds(
    s: dict[str, Any], base: np.ndarray, level: float, seed: list[int], samples: int = SAMPLES
) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of future values on the fitting scale: the trend may change again as often and as much as it did, and values
    scatter as the residuals did. Each day has a change with the fitted rate, of a Laplace size with the fitted mean."""
    rng = np.random.default_rng(seed)
    steps = np.asarray(s["coef"], float)[2:2 + len(s["changepoints"])]
    size = float(np.abs(steps).mean()) + 1e-8 if len(steps) else 0.0
    changes = rng.random((samples, len(base))) < 1.0 - np.exp(-len(steps) / s["span"])
    slope = np.cumsum(np.where(changes, rng.laplace(0.0, max(size, 1e-300), changes.shape), 0.0), axis=1)
    paths = np.cumsum(slope, axis=1) / s["span"] + rng.normal(0.0, 1.0, changes.shape) * s["residual_std"]
    low, high = np.quantile(paths, [(1 - level) / 2, (1 + level) / 2], axis=0)
    return base + np.minimum(low, 0.0), base + np.maximum(high, 0.0)


def panel_rows(df: DataFrame, keys: list[str], cfg: PanelConfig) -> DataFrame:
    flag = F.coalesce(F.col(cfg.holiday_col).cast("double"), F.lit(0.0)) if cfg.holiday_col in df.columns else F.lit(0.0)
    return df.filter(F.col(cfg.target_col).isNotNull() & F.col(cfg.date_col).isNotNull()).select(
        *keys, F.unix_date(cfg.date_col).cast("double").alias("day"),
        F.col(cfg.target_col).cast("double").alias("y"), flag.alias("holiday"),
    )


def key_fields(df: DataFrame, keys: list[str]) -> list[T.StructField]:
    return [T.StructField(k, df.schema[k].dataType) for k in keys]


def with_params(rows: DataFrame, keys: list[str], per_series: DataFrame | None) -> DataFrame:
    """Rows with the JSON text ``params`` of their series, NULL where none is given."""
    if per_series is None:
        return rows.withColumn("params", F.lit(None).cast("string"))
    return join_series(rows, per_series.select(*keys, "params"), keys)


def own_params(shared: dict[str, Any], text: Any) -> dict[str, Any]:
    return shared | (json.loads(text) if isinstance(text, str) else {})


def fit(
    df: DataFrame, keys: list[str], params: dict[str, Any] | None = None, cfg: PanelConfig = DEFAULT,
    per_series: DataFrame | None = None,
) -> Fitted:
    """One state row per series; a series of one value is its level.

    ``per_series`` (``keys, params`` as JSON) overrides ``params`` for the series it names.
    """
    p = DEFAULTS | (params or {})
    schema = T.StructType(key_fields(df, keys) + list(STATE))
    names = schema.names

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        day = pdf["day"].to_numpy(float)
        own = own_params(p, pdf["params"].iloc[0])
        s = fit_arrays(day, pdf["y"].to_numpy(float), pdf["holiday"].to_numpy(float), own)
        s |= {k: pdf[k].iloc[0] for k in keys}
        s |= {"n_train": len(day), "last_date": (pd.Timestamp(0) + pd.Timedelta(days=int(day[-1]))).date()}
        return pd.DataFrame([s])[names]

    rows = with_params(panel_rows(df, keys, cfg), keys, per_series)
    return Fitted(NAME, keys, p, rows.groupBy(*keys).applyInPandas(kernel, schema))


def forecast(
    fitted: Fitted, n_days: int, level: float = 0.95, include_ci: bool = True, limit: int | None = 365,
    holidays: DataFrame | None = None, samples: int = SAMPLES, seed: int = 42,
) -> DataFrame:
    """Forecast at the requested level. ``holidays`` (``keys, date``) marks future days with the effect.

    ``samples`` simulated futures, seeded by ``seed`` and the keys of the series, give the bounds.
    """
    check_horizon(n_days, limit)
    if not 0 < level < 1:
        raise ValueError("level must lie between 0 and 1")
    keys = fitted.keys
    fields = [T.StructField(c, T.DoubleType()) for c in ("plain", "lower", "upper", "effect")]
    schema = T.StructType(
        key_fields(fitted.series, keys)
        + [T.StructField("last_date", T.DateType()), T.StructField("is_log", T.BooleanType()),
           T.StructField("v", T.ArrayType(T.StructType(fields)))]
    )

    def kernel(batches):
        for pdf in batches:
            values = []
            for s in pdf.to_dict("records"):
                last = (pd.Timestamp(s["last_date"]) - pd.Timestamp(0)).days
                base = predict_arrays(s, last + np.arange(1.0, n_days + 1.0))
                own = zlib.crc32("\x1f".join(str(s[k]) for k in keys).encode())
                low, high = simulated_bounds(s, base, level, [seed, own], samples) if include_ci else (base, base)
                shift = [to_natural(s, v) for v in (base, low, high, base + s["holiday"])]
                values.append([dict(zip(("plain", "lower", "upper", "effect"), v)) for v in zip(*shift)])
            yield pdf[[*keys, "last_date", "is_log"]].assign(v=values)

    made = fitted.series.mapInPandas(kernel, schema)
    on = F.lit(False)
    if holidays is not None:
        marked = holidays.groupBy(*keys).agg(F.collect_set("date").alias("__days"))
        made = join_series(made, marked, keys)
        on = None

    def value(i, date):
        x = F.element_at("v", i)
        hit = on if on is not None else F.coalesce(F.array_contains("__days", date), F.lit(False))
        # A holiday moves the centre and both bounds: by a factor on the log scale, by a shift otherwise.
        moved = lambda v: F.when(
            hit, F.when(F.col("is_log"), v * F.try_divide(x["effect"], x["plain"])).otherwise(v + x["effect"] - x["plain"])
        ).otherwise(v)
        return {"predicted": moved(x["plain"]), "lower_bound": moved(x["lower"]), "upper_bound": moved(x["upper"])}

    return finish(made, keys, NAME, points(n_days, value), level, include_ci, native=True)


def candidate_errors(train: tuple, valid: tuple, candidates: list[dict[str, Any]]) -> list[float | None]:
    """Validation MAPE per candidate for one series; a failing fit gives None."""
    day, y, holiday = train
    vday, vy, vholiday = valid
    out: list[float | None] = []
    for c in candidates:
        try:
            s = fit_arrays(day, y, holiday, DEFAULTS | c)
            p = np.maximum(to_natural(s, predict_arrays(s, vday) + s["holiday"] * vholiday), 0.0)
            ok = vy != 0
            value = float(np.mean(np.abs((vy[ok] - p[ok]) / vy[ok])) * 100)
            out.append(value if np.isfinite(value) else None)
        except (np.linalg.LinAlgError, ValueError, FloatingPointError):
            out.append(None)
    return out
