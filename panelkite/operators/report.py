"""Text-level reports as tidy rows, projected from one-row-per-series statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkite.config import DEFAULT, PanelConfig
from panelkite.functions.keys import join_series
from panelkite.operators.eda import series_profile
from panelkite.operators.quality import duplicate_rows


def analysis(df: DataFrame, keys: list[str], cfg: PanelConfig = DEFAULT) -> DataFrame:
    """The analysis bundle: one row per series, duplicates of the raw rows included."""
    return join_series(series_profile(df, keys, cfg), duplicate_rows(df, keys), keys)


def insights(profile: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, ord, insight``: the rules that fire for each series, in a fixed order."""
    # Thresholds and wording of the insights.
    c = F.col
    top = F.try_element_at(c("correlations"), F.lit(1))
    r2 = F.format_string("%.3f", c("r_squared"))
    direction = c("trend_direction")
    rules = [
        F.when(c("r_squared") > 0.5, F.concat(F.lit("Strong "), direction, F.lit(" trend detected (R²="), r2, F.lit(")")))
        .when(c("r_squared") > 0.3, F.concat(F.lit("Moderate "), direction, F.lit(" trend detected (R²="), r2, F.lit(")")))
        .otherwise(F.lit("No strong linear trend detected")),
        F.when(
            F.abs("growth_rate_percent") > 50,
            F.format_string("Significant growth: %.1f%% from first to second half", "growth_rate_percent"),
        ),
        F.format_string("Day-of-week effect: %s is best, %s is worst", "best_day", "worst_day"),
        F.when(
            F.abs(top["correlation"]) > 0.7,
            F.format_string("Strong correlation: %s (r=%.3f)", top["column"], top["correlation"]),
        ),
        F.when(
            c("lag_1") > 0.5,
            F.format_string("High autocorrelation at lag-1: %.3f (good for time series models)", "lag_1"),
        ),
        F.when(c("duplicates") > 0, F.format_string("Warning: %d duplicate rows found", "duplicates")),
        F.when(
            c("columns_with_nulls") > 0,
            F.format_string("Warning: Missing values in %d columns", "columns_with_nulls"),
        ),
        F.when(c("date_gaps") > 0, F.format_string("Warning: %d date gaps found", "date_gaps")),
    ]
    fired = F.array_compact(F.array(*rules))
    return profile.select(*keys, F.posexplode(fired).alias("i", "insight")).select(
        *keys, (F.col("i") + 1).alias("ord"), "insight"
    )


def _dollars(c: Column | str) -> Column:
    return F.format_string("$%,.2f", c)


def section_report(profile: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, section, ord, label, value`` in six sections."""
    # Section titles, labels and number formats of the report.
    c = F.col
    sections: list[tuple[str, list[tuple[str, Column]]]] = [
        ("1. BASIC STATISTICS", [
            ("Total Records", F.format_string("%,d", "count")),
            ("Date Range", F.concat(c("date_start").cast("string"), F.lit(" to "), c("date_end").cast("string"))),
            ("Mean Sales", _dollars("mean")),
            ("Std Dev", _dollars("std")),
            ("Min", _dollars("min")),
            ("Max", _dollars("max")),
            ("Coefficient of Variation", F.format_string("%.2f%%", "cv")),
        ]),
        ("2. TREND ANALYSIS", [
            ("Trend Direction", F.upper("trend_direction")),
            ("Daily Change", _dollars("slope")),
            ("R-squared", F.format_string("%.4f", "r_squared")),
            ("Growth Rate", F.format_string("%.1f%%", "growth_rate_percent")),
        ]),
        ("3. SEASONALITY", [
            ("Best Day", c("best_day")),
            ("Worst Day", c("worst_day")),
            ("Weekend vs Weekday", F.format_string("$%,.0f vs $%,.0f", "weekend_avg", "weekday_avg")),
            ("Lag-1 Autocorrelation", F.format_string("%.4f", "lag_1")),
            ("Lag-7 Autocorrelation", F.format_string("%.4f", "lag_7")),
        ]),
        ("5. DATA QUALITY", [
            ("Missing Values", F.format_string("%d columns with missing data", "columns_with_nulls")),
            ("Duplicates", c("duplicates").cast("string")),
            ("Date Gaps", c("date_gaps").cast("string")),
        ]),
        ("6. OUTLIERS", [
            ("IQR Method", F.format_string("%d outliers (%.1f%%)", "iqr_outliers", "iqr_outlier_percent")),
            ("Z-Score Method", F.format_string("%d outliers (%.1f%%)", "zscore_outliers", "zscore_outlier_percent")),
        ]),
    ]
    lines = [
        F.struct(F.lit(s).alias("section"), F.lit(i).alias("ord"), F.lit(label).alias("label"), value.alias("value"))
        for s, items in sections
        for i, (label, value) in enumerate(items, 1)
    ]
    top = F.transform(
        F.slice("correlations", 1, 5),
        lambda x, i: F.struct(
            F.lit("4. TOP CORRELATIONS").alias("section"),
            (i + 1).alias("ord"),
            x["column"].alias("label"),
            F.format_string("%.4f", x["correlation"]).alias("value"),
        ),
    )
    return profile.select(*keys, F.inline(F.concat(F.array(*lines), top)))


def tidy(wide: DataFrame, keys: list[str], section: str) -> DataFrame:
    """Numeric columns of a one-row-per-series frame as ``keys, section, key, value``."""
    cols = [n for n, t in wide.dtypes if n not in keys and t in ("double", "bigint", "int", "float")]
    long = wide.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(keys, cols, "key", "value")
    return long.select(*keys, F.lit(section).alias("section"), "key", "value")
