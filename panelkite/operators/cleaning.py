"""Cleaning raw sales rows: names, dates, types, missing values, duplicates, outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkite.config import DEFAULT, PanelConfig, numeric_columns
from panelkite.functions.keys import attach_rows, first_per, long_form, null_if_nan, series_window
from panelkite.functions.windows import forward_back_fill
from panelkite.sources.readers import coerce_types, parse_date


def standardize_names(df: DataFrame) -> DataFrame:
    """Lower case, trimmed, spaces to underscores (metadata only)."""
    return df.toDF(*[c.lower().strip().replace(" ", "_") for c in df.columns])


def parse_dates(df: DataFrame, cfg: PanelConfig = DEFAULT) -> DataFrame:
    """Date column to ``date``; a string that no format reads becomes NULL."""
    if cfg.date_col not in df.columns:
        return df
    kind = df.schema[cfg.date_col].dataType
    c = F.col(cfg.date_col)
    if isinstance(kind, T.DateType):
        return df
    parsed = parse_date(c, cfg) if isinstance(kind, T.StringType) else c.cast("date")
    return df.withColumn(cfg.date_col, parsed)


def fill_numeric(
    df: DataFrame, keys: list[str], columns: list[str] | None = None, cfg: PanelConfig = DEFAULT
) -> DataFrame:
    """Forward then backward fill in date order, one Window operator for all columns.

    Expects one row per (keys, date), which bounds a series by the calendar.
    """
    columns = columns or numeric_columns(df, exclude=keys)
    w = series_window(keys, cfg.date_col)
    return df.select(
        *[forward_back_fill(F.col(c), w).alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def modes(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Most frequent value per series and column, smallest on ties, as one row per series.

    Values are counted first, on the map side as well, so no task holds a group's raw rows.
    """
    long = long_form(df, keys, columns, "string").filter(F.col("v").isNotNull())
    counted = long.groupBy(*keys, "column", "v").agg(F.count("*").alias("__n"))
    best = counted.groupBy(*keys, "column").agg(F.min(F.struct((-F.col("__n")).alias("n"), "v")).alias("__m"))
    return best.groupBy(*keys).agg(
        *[F.max(F.when(F.col("column") == c, F.col("__m.v"))).alias(f"__mode_{c}") for c in columns]
    )


def fill_mode(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """NULLs of categorical columns take the series mode."""
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df
    joined = attach_rows(df, modes(df, keys, columns), keys)
    return joined.select(
        *[F.coalesce(F.col(c), F.col(f"__mode_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def drop_duplicates(
    df: DataFrame, keys: list[str], order: list[Column] | None = None, cfg: PanelConfig = DEFAULT
) -> DataFrame:
    """One row per (keys, date): the first under ``order``.

    Exact duplicates fall out by the same rule. The default order is the whole row, column by column
    with NULL last, so a known value is kept before a missing one; for input order see
    :func:`with_file_order`.
    """
    by = [*keys, cfg.date_col]
    order = order or [F.struct(F.col(c).isNull().alias("missing"), F.col(c).alias("v")) for c in df.columns if c not in by]
    return first_per(df, by, order)


def with_file_order(scan: DataFrame) -> DataFrame:
    """Add the input order of a Parquet scan, for ``clean(..., order=FILE_ORDER)``."""
    return scan.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))


FILE_ORDER = ("__file", "__row")


def clean(
    df: DataFrame,
    keys: list[str] | None = None,
    order: tuple[str, ...] | list[str] = (),
    cfg: PanelConfig = DEFAULT,
) -> DataFrame:
    """Names, dates, types, one row per (keys, date), then fills.

    ``order`` names columns that say which duplicate comes first; they are dropped afterwards.
    Duplicates go before the fills, so the fill windows see one row per day and a fill takes its
    value from the row that stays. Rows without a date cannot be placed in a series and are dropped.
    """
    keys = keys or []
    out = null_if_nan(coerce_types(parse_dates(standardize_names(df), cfg), cfg))
    out = out.filter(F.col(cfg.date_col).isNotNull())
    out = drop_duplicates(out, keys, [F.col(c) for c in order] or None, cfg).drop(*order)
    numeric = numeric_columns(out, exclude=keys)
    if numeric:
        out = fill_numeric(out, keys, numeric, cfg)
    text = [f.name for f in out.schema if isinstance(f.dataType, T.StringType) and f.name not in keys]
    return fill_mode(out, keys, text)


def handle_outliers(
    df: DataFrame,
    keys: list[str],
    columns: list[str] | None = None,
    method: str = "clip",
    n_std: float = 3.0,
    cfg: PanelConfig = DEFAULT,
) -> DataFrame:
    """Clip to, or drop outside, mean +/- ``n_std`` sample deviations per series.

    Clipping uses one statistics pass for all columns. Removal is sequential, because each later
    column must see only the rows that are left.
    """
    if method not in ("clip", "remove"):
        raise ValueError("method must be clip or remove")
    columns = [c for c in (columns or [cfg.target_col, cfg.spend_col]) if c in df.columns]
    if method == "clip":
        bounded = attach_rows(df, _bounds(df, keys, columns, n_std), keys)
        return bounded.select(*[_clip(c) if c in columns else F.col(c) for c in df.columns])
    out = df
    for c in columns:
        bounded = attach_rows(out, _bounds(out, keys, [c], n_std), keys)
        outside = (F.col(c) < F.col(f"__lo_{c}")) | (F.col(c) > F.col(f"__hi_{c}"))
        out = bounded.filter(~F.coalesce(outside, F.lit(False))).select(*df.columns)
    return out


def _bounds(df: DataFrame, keys: list[str], columns: list[str], n_std: float) -> DataFrame:
    aggs = []
    for c in columns:
        spread = F.lit(n_std) * F.stddev_samp(c)
        aggs += [(F.avg(c) - spread).alias(f"__lo_{c}"), (F.avg(c) + spread).alias(f"__hi_{c}")]
    return df.groupBy(*keys).agg(*aggs)


def _clip(c: str) -> Column:
    x, lo, hi = F.col(c), F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
    return F.when(x < lo, lo).when(x > hi, hi).otherwise(x).alias(c)


def cleaning_report(before: DataFrame, after: DataFrame, keys: list[str], cfg: PanelConfig = DEFAULT) -> DataFrame:
    """``operation, count`` rows: renamed columns, filled values, removed rows, rows without a date."""
    spark = before.sparkSession
    named = standardize_names(before)
    renamed = sum(a != b for a, b in zip(before.columns, named.columns))
    typed = null_if_nan(coerce_types(parse_dates(named, cfg), cfg))
    dated = typed.filter(F.col(cfg.date_col).isNotNull())
    kept = drop_duplicates(dated, keys, cfg=cfg)
    nulls = sum((F.col(c).isNull().cast("long") for c in kept.columns if c not in keys), F.lit(0))
    counts = (
        typed.agg(F.count("*").alias("n"), F.count(cfg.date_col).alias("dated"))
        .select((F.col("n") - F.col("dated")).alias("undated"), "dated")
    )
    kept_counts = kept.agg(F.count("*").alias("kept"), F.coalesce(F.sum(nulls), F.lit(0)).alias("null_before"))
    after_nulls = sum((F.col(c).isNull().cast("long") for c in after.columns if c not in keys), F.lit(0))
    left = after.agg(F.coalesce(F.sum(after_nulls), F.lit(0)).alias("null_after"))
    one = spark.range(1).select(
        counts.select(F.struct("undated", "dated")).scalar().alias("c"),
        kept_counts.select(F.struct("kept", "null_before")).scalar().alias("k"),
        left.scalar().alias("null_after"),
    )
    ops = F.array(
        *[
            F.struct(F.lit(name).alias("operation"), value.cast("long").alias("count"))
            for name, value in (
                ("renamed_columns", F.lit(renamed)),
                ("rows_without_date", F.col("c.undated")),
                ("duplicate_rows_removed", F.col("c.dated") - F.col("k.kept")),
                ("values_filled", F.col("k.null_before") - F.col("null_after")),
            )
        ]
    )
    return one.select(F.inline(ops))
