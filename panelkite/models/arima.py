"""Seasonal ARIMA by two-stage least squares (Hannan and Rissanen), weekly season.

Re-aimed: a long autoregression estimates the shocks, then one regression on lagged values and lagged
shocks gives the coefficients; seasonal terms enter at multiples of seven. Intervals come from the
psi-weights. Not equal to a maximum-likelihood fit. A series that is too short, or whose fit fails,
falls back to order (1,1,1) without a season. Where that fails too the series has the state of a random walk
from its last value, so no series is lost.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkite.config import DEFAULT, PanelConfig
from panelkite.functions.scalars import z_value
from panelkite.models.base import Fitted, check_horizon, finish, points
from panelkite.models.decomposable import key_fields, own_params, panel_rows, with_params

NAME = "seasonal_arima"
# Default parameters, season length and fallback order.
DEFAULTS = {"p": 1, "d": 1, "q": 1, "P": 0, "D": 0, "Q": 0, "trend": "t"}
SEASON = 7
FALLBACK = {"p": 1, "d": 1, "q": 1, "P": 0, "D": 0, "Q": 0, "trend": "t"}

_ARRAY = T.ArrayType(T.DoubleType())
STATE = T.StructType([
    T.StructField("n_train", T.LongType()),
    T.StructField("last_date", T.DateType()),
    T.StructField("order", T.StringType()),
    T.StructField("ar", _ARRAY),
    T.StructField("ma", _ARRAY),
    T.StructField("const", T.DoubleType()),
    T.StructField("slope", T.DoubleType()),
    T.StructField("t_last", T.DoubleType()),
    T.StructField("y_tail", _ARRAY),
    T.StructField("e_tail", _ARRAY),
    T.StructField("sigma", T.DoubleType()),
    T.StructField("aic", T.DoubleType()),
    T.StructField("train_mape", T.DoubleType()),
    T.StructField("train_mae", T.DoubleType()),
    T.StructField("train_rmse", T.DoubleType()),
])


def _lags(short: int, seasonal: int) -> list[int]:
    return sorted(set(range(1, short + 1)) | {SEASON * k for k in range(1, seasonal + 1)})


def _stack(series: np.ndarray, lags: list[int], start: int) -> np.ndarray:
    return np.column_stack([series[start - k:len(series) - k] for k in lags]) if lags else np.empty((len(series) - start, 0))


def _trend_columns(trend: str, start: int, n: int) -> np.ndarray:
    t = np.arange(start + 1, n + 1, dtype=float)
    return {"n": np.empty((n - start, 0)), "c": np.ones((n - start, 1)), "t": t[:, None],
            "ct": np.column_stack([np.ones_like(t), t])}[trend]


def _stable(coef: np.ndarray, lags: list[int]) -> np.ndarray:
    """Shrink a lag polynomial whose recursion would explode back inside the unit circle."""
    if not lags:
        return coef
    size = max(lags)
    companion = np.zeros((size, size))
    companion[0, [k - 1 for k in lags]] = coef
    companion[np.arange(1, size), np.arange(size - 1)] = 1.0
    radius = float(np.abs(np.linalg.eigvals(companion)).max())
    return coef * np.power(0.99 / radius, lags) if radius >= 0.999 else coef


def fit_arrays(y: np.ndarray, p: dict[str, Any]) -> dict[str, Any]:
    """State of one series; falls back once to the simplest order."""
    try:
        return _fit(y, p)
    except (np.linalg.LinAlgError, ValueError, FloatingPointError):
        return _fit(y, FALLBACK)


def _last_value(y: np.ndarray) -> dict[str, Any]:
    """A random walk from the last value; a single value has no error and no spread."""
    steps = np.diff(y)
    err = np.abs(steps)
    seen = len(steps) > 0
    return {
        "order": "last value", "ar": np.ones(1), "ma": np.zeros(0), "const": 0.0, "slope": 0.0, "t_last": float(len(y)),
        "y_tail": y[-1:].astype(float), "e_tail": np.zeros(0),
        "sigma": float(np.sqrt((steps ** 2).mean())) if seen else 0.0, "aic": None,
        "train_mape": float((err / np.maximum(np.abs(y[1:]), np.finfo(float).eps)).mean() * 100) if seen else None,
        "train_mae": float(err.mean()) if seen else None,
        "train_rmse": float(np.sqrt((steps ** 2).mean())) if seen else None,
    }


def _fit(y: np.ndarray, p: dict[str, Any]) -> dict[str, Any]:
    w = y.astype(float)
    full = np.array([1.0])
    for step, times in ((1, p["d"]), (SEASON, p["D"])):
        for _ in range(times):
            w = w[step:] - w[:-step]
            full = np.convolve(full, np.concatenate([[1.0], np.zeros(step - 1), [-1.0]]))
    ar_lags, ma_lags = _lags(p["p"], p["P"]), _lags(p["q"], p["Q"])
    n, reach = len(w), max([0, *ar_lags, *ma_lags])
    long = min(max(reach, int(10 * np.log10(max(n, 2)))), n // 4) if ma_lags else 0
    k = len(ar_lags) + len(ma_lags) + {"n": 0, "c": 1, "t": 1, "ct": 2}[p["trend"]]
    if n - long - reach < max(2 * k, 4):
        raise ValueError("series too short for this order")
    shocks = np.zeros(n)
    if ma_lags:
        x = np.column_stack([_trend_columns(p["trend"], long, n), _stack(w, list(range(1, long + 1)), long)])
        shocks[long:] = w[long:] - x @ np.linalg.lstsq(x, w[long:], rcond=None)[0]
    start = long + reach
    trend = _trend_columns(p["trend"], start, n)
    x = np.column_stack([trend, _stack(w, ar_lags, start), _stack(shocks, ma_lags, start)])
    beta = np.linalg.lstsq(x, w[start:], rcond=None)[0] if x.shape[1] else np.zeros(0)
    nt, na = trend.shape[1], len(ar_lags)
    phi = _stable(beta[nt:nt + na], ar_lags)
    theta = -_stable(-beta[nt + na:], ma_lags)
    if (phi != beta[nt:nt + na]).any() or (theta != beta[nt + na:]).any():
        # The trend is refitted around shrunk dynamics so that the level stays right.
        rest = w[start:] - _stack(w, ar_lags, start) @ phi - _stack(shocks, ma_lags, start) @ theta
        tb = np.linalg.lstsq(trend, rest, rcond=None)[0] if nt else np.zeros(0)
    else:
        tb = beta[:nt]
    const = float(tb[0]) if p["trend"] in ("c", "ct") else 0.0
    slope = float(tb[-1]) if p["trend"] in ("t", "ct") else 0.0
    ar_max, ma_max = max([0, *ar_lags]), max([0, *ma_lags])
    # Without shocks all residuals are known at once; only moving-average terms need the recursion.
    e = np.zeros(n)
    e[ar_max:] = w[ar_max:] - const - slope * np.arange(ar_max + 1, n + 1) - _stack(w, ar_lags, ar_max) @ phi
    if ma_lags:
        run, terms = e.tolist(), list(zip(ma_lags, theta.tolist()))
        for i in range(ar_max, n):
            run[i] -= sum(c * run[i - lag] for lag, c in terms if i >= lag)
        e = np.array(run)
    used = e[start:]
    sse = float(used @ used)
    sigma = float(np.sqrt(sse / max(len(used) - k, 1)))
    if not np.isfinite(sigma):
        raise ValueError("diverging residuals")
    poly = np.zeros(ar_max + 1)
    poly[0] = 1.0
    for lag, c in zip(ar_lags, phi):
        poly[lag] = -c
    ar = -np.convolve(poly, full)[1:]
    ma = np.zeros(ma_max)
    for lag, c in zip(ma_lags, theta):
        ma[lag - 1] = c
    actual, err = y[len(y) - len(used):], np.abs(used)
    m = len(used)
    return {
        "order": f"({p['p']},{p['d']},{p['q']})({p['P']},{p['D']},{p['Q']},{SEASON}) {p['trend']}",
        "ar": ar, "ma": ma, "const": const, "slope": slope, "t_last": float(n),
        "y_tail": y[max(len(y) - len(ar), 0):], "e_tail": e[max(n - ma_max, 0):] if ma_max else np.zeros(0),
        "sigma": sigma, "aic": float(m * np.log(max(sse / m, 1e-300)) + 2 * (k + 1)),
        "train_mape": float((err / np.maximum(np.abs(actual), np.finfo(float).eps)).mean() * 100),
        "train_mae": float(err.mean()), "train_rmse": float(np.sqrt((err ** 2).mean())),
    }


def predict_many(ar: np.ndarray, ma: np.ndarray, y_tail: np.ndarray, e_tail: np.ndarray, level: np.ndarray,
                 slope: np.ndarray, t_last: np.ndarray, sigma: np.ndarray, n_days: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and standard errors, one row per series; all series step through the days together.

    The arrays hold one series per row; the series have equally many terms and kept values.
    """
    rows, na, nm = len(ar), ar.shape[1], ma.shape[1]
    y = np.concatenate([y_tail, np.zeros((rows, n_days))], axis=1)
    e = np.concatenate([e_tail, np.zeros((rows, n_days))], axis=1)
    ny, ne = y_tail.shape[1], e_tail.shape[1]
    psi = np.zeros((rows, n_days))
    psi[:, 0] = 1.0
    for h in range(n_days):
        mean = level + slope * (t_last + h + 1)
        if na:
            mean = mean + (ar * y[:, ny + h - na:ny + h][:, ::-1]).sum(axis=1)
        if nm:
            mean = mean + (ma * e[:, ne + h - nm:ne + h][:, ::-1]).sum(axis=1)
        y[:, ny + h] = mean
        if h:
            reach = min(h, na)
            psi[:, h] = (ar[:, :reach] * psi[:, h - reach:h][:, ::-1]).sum(axis=1) + (ma[:, h - 1] if h <= nm else 0.0)
    return y[:, ny:], sigma[:, None] * np.sqrt(np.cumsum(psi ** 2, axis=1))


VECTORS, NUMBERS = ("ar", "ma", "y_tail", "e_tail"), ("const", "slope", "t_last", "sigma")


def predict_arrays(s: dict[str, Any], n_days: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and standard errors of the next n_days values."""
    one = [np.asarray(s[c], float)[None, :] for c in VECTORS] + [np.array([s[c]], float) for c in NUMBERS]
    mean, se = predict_many(*one, n_days)
    return mean[0], se[0]


def predict_frame(states: pd.DataFrame, n_days: int) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`predict_many` for state rows of any orders: rows of one shape are stacked and solved at once."""
    mean, se = np.zeros((2, len(states), n_days))
    shape = pd.Series(list(zip(*[states[c].map(len) for c in VECTORS])))
    for _, at in shape.groupby(shape).indices.items():
        part = states.iloc[at]
        stacked = [np.stack([np.asarray(v, float) for v in part[c]]) for c in VECTORS]
        mean[at], se[at] = predict_many(*stacked, *[part[c].to_numpy(float) for c in NUMBERS], n_days)
    return mean, se


def fit(
    df: DataFrame, keys: list[str], params: dict[str, Any] | None = None, cfg: PanelConfig = DEFAULT,
    per_series: DataFrame | None = None, keep_short: bool = True,
) -> Fitted:
    """One state row per series; the series, bounded by the calendar, is one Arrow group.

    ``per_series`` (``keys, params`` as JSON) overrides ``params`` for the series it names. A series too short for
    any order is continued from its last value, or left out without ``keep_short``.
    """
    p = DEFAULTS | (params or {})
    schema = T.StructType(key_fields(df, keys) + list(STATE))
    names = schema.names

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        y = pdf["y"].to_numpy(float)
        try:
            s = fit_arrays(y, own_params(p, pdf["params"].iloc[0]))
        except (np.linalg.LinAlgError, ValueError):
            if not keep_short:
                return pd.DataFrame(columns=names)
            s = _last_value(y)
        last = int(pdf["day"].iloc[-1])
        s |= {k: pdf[k].iloc[0] for k in keys}
        s |= {"n_train": len(y), "last_date": (pd.Timestamp(0) + pd.Timedelta(days=last)).date()}
        return pd.DataFrame([s])[names]

    rows = with_params(panel_rows(df, keys, cfg), keys, per_series)
    return Fitted(NAME, keys, p, rows.groupBy(*keys).applyInPandas(kernel, schema))


def forecast(
    fitted: Fitted, n_days: int, level: float = 0.95, include_ci: bool = True, limit: int | None = 365
) -> DataFrame:
    check_horizon(n_days, limit)
    keys, z = fitted.keys, z_value(level)
    point = T.StructType([T.StructField(c, T.DoubleType()) for c in ("predicted", "se")])
    schema = T.StructType(
        key_fields(fitted.series, keys) + [T.StructField("last_date", T.DateType()), T.StructField("v", T.ArrayType(point))]
    )

    def kernel(batches):
        for pdf in batches:
            mean, se = predict_frame(pdf, n_days)
            paths = [[{"predicted": m, "se": d} for m, d in zip(*row)] for row in zip(mean.tolist(), se.tolist())]
            yield pdf[[*keys, "last_date"]].assign(v=paths)

    def value(i, _):
        x = F.element_at("v", i)
        return {"predicted": x["predicted"], "lower_bound": x["predicted"] - z * x["se"],
                "upper_bound": x["predicted"] + z * x["se"]}

    made = fitted.series.mapInPandas(kernel, schema)
    return finish(made, keys, NAME, points(n_days, value), level, include_ci, native=True)


def candidate_errors(train: tuple, valid: tuple, candidates: list[dict[str, Any]]) -> list[float | None]:
    day, y, _ = train
    vday, vy, _ = valid
    steps = (vday - day[-1]).astype(int) - 1
    out: list[float | None] = []
    for c in candidates:
        try:
            mean, _ = predict_arrays(fit_arrays(y, DEFAULTS | c), int(steps[-1]) + 1)
            p, ok = np.maximum(mean[steps], 0.0), vy != 0
            value = float(np.mean(np.abs((vy[ok] - p[ok]) / vy[ok])) * 100)
            out.append(value if np.isfinite(value) else None)
        except (np.linalg.LinAlgError, ValueError, FloatingPointError):
            out.append(None)
    return out
