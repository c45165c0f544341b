"""Leak-free temporal splits, as rows tagged with ``fold`` and ``role``.

Fold bounds are arithmetic on a row's position and its series length, so membership is computed per
row and exploded into the folds that hold it; no join with a fold table is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkite.config import DEFAULT, PanelConfig
from panelkite.functions.keys import series_window, whole_series


def _placed(df: DataFrame, keys: list[str], cfg: PanelConfig) -> DataFrame:
    return df.select(
        "*",
        (F.row_number().over(series_window(keys, cfg.date_col)) - 1).alias("__pos"),
        F.count(F.lit(1)).over(whole_series(keys, cfg.date_col)).alias("__n"),
    )


def simple_split(
    df: DataFrame,
    keys: list[str],
    train_ratio: float = 0.8,
    test_size: float | None = None,
    cfg: PanelConfig = DEFAULT,
) -> DataFrame:
    """First part of each series by date is ``train``, the rest ``test``; ``test_size`` overrides the ratio."""
    ratio = 1 - test_size if test_size is not None else train_ratio
    cut = F.floor(F.col("__n") * F.lit(float(ratio)))
    role = F.when(F.col("__pos") < cut, "train").otherwise("test")
    return _placed(df, keys, cfg).select(*df.columns, F.lit(0).alias("fold"), role.alias("role"))


def walk_forward_split(
    df: DataFrame,
    keys: list[str],
    n_splits: int = 5,
    test_size: int | None = None,
    min_train_size: int | None = None,
    cfg: PanelConfig = DEFAULT,
) -> DataFrame:
    """Expanding training window; each fold tests on the block after it."""
    n = F.col("__n")
    least = F.lit(min_train_size) if min_train_size is not None else F.floor(n / 2)
    size = F.lit(test_size) if test_size is not None else F.floor((n - least) / n_splits)

    def fold(f: Column) -> tuple[Column, Column, Column, Column]:
        train_end = least + f * size
        test_end = F.least(train_end + size, n)
        return F.lit(0), train_end, test_end, test_end > train_end

    return _explode_folds(df, keys, n_splits, fold, cfg)


def sliding_window_split(
    df: DataFrame,
    keys: list[str],
    n_splits: int = 5,
    train_size: int | None = None,
    test_size: int | None = None,
    cfg: PanelConfig = DEFAULT,
) -> DataFrame:
    """Training window of fixed size that moves on by one test block per fold."""
    n = F.col("__n")
    width = F.lit(train_size) if train_size is not None else F.floor(n / 2)
    size = F.lit(test_size) if test_size is not None else F.floor((n - width) / n_splits)

    def fold(f: Column) -> tuple[Column, Column, Column, Column]:
        start = f * size
        train_end = start + width
        test_end = F.least(train_end + size, n)
        return start, train_end, test_end, (test_end > train_end) & (train_end <= n)

    return _explode_folds(df, keys, n_splits, fold, cfg)


def _explode_folds(df: DataFrame, keys: list[str], n_splits: int, fold, cfg: PanelConfig) -> DataFrame:
    pos = F.col("__pos")

    def member(f: Column) -> Column:
        start, train_end, test_end, valid = fold(f)
        role = F.when((pos >= start) & (pos < train_end), "train").when(
            (pos >= train_end) & (pos < test_end), "test"
        )
        return F.when(valid & role.isNotNull(), F.struct(f.cast("int").alias("fold"), role.alias("role")))

    folds = F.array_compact(F.array(*[member(F.lit(i)) for i in range(n_splits)]))
    return _placed(df, keys, cfg).select(*df.columns, F.inline(folds))


def split_info(split: DataFrame, keys: list[str], cfg: PanelConfig = DEFAULT) -> DataFrame:
    """``keys, fold`` with the date span and size of both roles."""
    d = F.col(cfg.date_col)

    def on(role: str) -> Column:
        return F.when(F.col("role") == role, d)

    return split.groupBy(*keys, "fold").agg(
        F.min(on("train")).alias("train_start"),
        F.max(on("train")).alias("train_end"),
        F.min(on("test")).alias("test_start"),
        F.max(on("test")).alias("test_end"),
        F.count_if(F.col("role") == "train").alias("train_size"),
        F.count_if(F.col("role") == "test").alias("test_size"),
    )


def feature_columns(
    df: DataFrame,
    target: str,
    features: list[str] | None = None,
    exclude: list[str] | None = None,
    cfg: PanelConfig = DEFAULT,
) -> list[str]:
    """Explicit features, else every column but the date, the target and the excluded ones."""
    if features is not None:
        return [c for c in features if c in df.columns]
    dropped = set(exclude if exclude is not None else cfg.categorical_columns) | {cfg.date_col, target}
    return [c for c in df.columns if c not in dropped]


def feature_target_split(
    df: DataFrame, target: str, features: list[str] | None = None, exclude: list[str] | None = None,
    cfg: PanelConfig = DEFAULT,
) -> tuple[DataFrame, DataFrame]:
    return df.select(*feature_columns(df, target, features, exclude, cfg)), df.select(target)
