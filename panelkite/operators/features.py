"""Feature engineering on a daily panel, in a minimal (15) and a full (68) set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from panelkite.config import DEFAULT, PanelConfig, numeric_columns
from panelkite.functions import calendar as cal
from panelkite.functions import windows as win
from panelkite.functions.keys import series_window, whole_series


# Fixed values, in all functions below: the names of the features.


def trend_scalars(keys: list[str], cfg: PanelConfig = DEFAULT) -> dict[str, Column]:
    """Days since the first date of the series, and the same as a share of its span (0 if the span is 0)."""
    whole = whole_series(keys, cfg.date_col)
    first, last = F.min(cfg.date_col).over(whole), F.max(cfg.date_col).over(whole)
    days = F.datediff(F.col(cfg.date_col), first)
    return {
        "days_since_start": days,
        "time_normalized": F.coalesce(F.try_divide(days, F.datediff(last, first)), F.lit(0.0)),
    }


def minimal_features(
    df: DataFrame, keys: list[str], include_target_lags: bool = True, cfg: PanelConfig = DEFAULT
) -> dict[str, Column]:
    y, d, w = cfg.target_col, F.col(cfg.date_col), series_window(keys, cfg.date_col)
    out = cal.minimal_date(d) | cal.cyclical(d, ("day_of_week",))
    if include_target_lags:
        out |= {
            f"{y}_lag_1": win.lag(F.col(y), 1, w),
            f"{y}_lag_7": win.lag(F.col(y), 7, w),
            f"{y}_diff_1": win.diff(F.col(y), 1, w),
        }
    out |= {
        f"{y}_rolling_mean_7": win.rolling(F.col(y), "mean", 7, w),
        f"{y}_rolling_std_7": win.rolling(F.col(y), "std", 7, w),
    }
    if cfg.spend_col in df.columns:
        out[f"{cfg.spend_col}_rolling_mean_7"] = win.rolling(F.col(cfg.spend_col), "mean", 7, w)
    return out | trend_scalars(keys, cfg)


def lag_features(df: DataFrame, keys: list[str], cfg: PanelConfig = DEFAULT) -> dict[str, Column]:
    y, w = cfg.target_col, series_window(keys, cfg.date_col)
    out: dict[str, Column] = {}
    for k in cfg.lag_days:
        out[f"{y}_lag_{k}"] = win.lag(F.col(y), k, w)
        if cfg.spend_col in df.columns:
            out[f"{cfg.spend_col}_lag_{k}"] = win.lag(F.col(cfg.spend_col), k, w)
    for k in (1, 7):
        out[f"{y}_diff_{k}"] = win.diff(F.col(y), k, w)
    for k in (1, 7):
        out[f"{y}_pct_change_{k}"] = win.pct_change(F.col(y), k, w)
    return out


def rolling_features(df: DataFrame, keys: list[str], cfg: PanelConfig = DEFAULT) -> dict[str, Column]:
    y, w = cfg.target_col, series_window(keys, cfg.date_col)
    out: dict[str, Column] = {}
    for n in cfg.rolling_windows:
        for stat in win.ROLLING:
            out[f"{y}_rolling_{stat}_{n}"] = win.rolling(F.col(y), stat, n, w)
        if cfg.spend_col in df.columns:
            out[f"{cfg.spend_col}_rolling_mean_{n}"] = win.rolling(F.col(cfg.spend_col), "mean", n, w)
    return out


def ratio_features(keys: list[str], cfg: PanelConfig = DEFAULT) -> dict[str, Column]:
    y, w = F.col(cfg.target_col), series_window(keys, cfg.date_col)
    return {"sales_vs_last_week": win.ratio(y, 7, w), "sales_vs_last_month": win.ratio(y, 28, w)}


def interaction_features(
    df: DataFrame, keys: list[str], available: set[str], cfg: PanelConfig = DEFAULT
) -> dict[str, Column]:
    y, d, w = F.col(cfg.target_col), F.col(cfg.date_col), series_window(keys, cfg.date_col)
    out: dict[str, Column] = {}
    if cfg.holiday_col in df.columns:
        out["holiday_weekend"] = F.col(cfg.holiday_col) * cal.flag(F.weekday(d) >= 5)
    if cfg.spend_col in df.columns:
        efficiency = F.try_divide(y, F.col(cfg.spend_col))
        out["marketing_efficiency"] = efficiency
        out["marketing_efficiency_lag_7"] = F.lag(efficiency, 7).over(w)
    for n in (7, 28):
        if f"{cfg.target_col}_rolling_mean_{n}" in available:
            out[f"sales_deviation_{n}"] = y - win.rolling(y, "mean", n, w)
    return out


def create_features(
    df: DataFrame,
    keys: list[str] | None = None,
    mode: str = "minimal",
    include_target_lags: bool = True,
    cfg: PanelConfig = DEFAULT,
) -> DataFrame:
    """Add the ``minimal`` or ``full`` feature set to a daily panel.

    Every expression shares one (series, date) window, hence one exchange and one sort; the
    exponentially weighted means add two more passes over the same partitions.
    """
    keys = keys or []
    if mode == "minimal":
        return cal.add_columns(df, minimal_features(df, keys, include_target_lags, cfg))
    if mode != "full":
        raise ValueError("mode must be minimal or full")
    d = F.col(cfg.date_col)
    rolled = rolling_features(df, keys, cfg)
    exprs = cal.full_date(d) | cal.cyclical(d)
    if include_target_lags:
        exprs |= lag_features(df, keys, cfg)
    exprs |= rolled | trend_scalars(keys, cfg) | ratio_features(keys, cfg)
    exprs |= interaction_features(df, keys, set(rolled), cfg)
    out = cal.add_columns(df, exprs)
    return win.with_ewm(out, keys, cfg.date_col, cfg.target_col, cfg.ewm_spans)


def feature_names(before: DataFrame, after: DataFrame) -> list[str]:
    """Created columns in order (metadata only)."""
    known = set(before.columns)
    return [c for c in after.columns if c not in known]


def feature_summary(df: DataFrame, features: list[str], keys: list[str] | None = None) -> DataFrame:
    """``keys, feature, total_features, nulls``."""
    keys = keys or []
    counted = df.groupBy(*keys).agg(*[F.count_if(F.col(f).isNull()).alias(f) for f in features])
    long = counted.unpivot(keys, features, "feature", "nulls")
    return long.select(*keys, "feature", F.lit(len(features)).cast("long").alias("total_features"), "nulls")


def drop_null_rows(
    df: DataFrame, subset: list[str] | None = None, seen: Observation | None = None
) -> DataFrame:
    """Drop rows that are NULL in any numeric column (or any of ``subset``).

    With an observation, ``rows`` and ``dropped`` are counted by the job that consumes the result.
    """
    subset = subset or numeric_columns(df)
    if seen is not None:
        incomplete = F.lit(False)
        for c in subset:
            incomplete = incomplete | F.col(c).isNull()
        df = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(incomplete).alias("dropped"))
    return df.dropna(subset=subset)
