"""Column names, validation bounds and feature settings, as one immutable value."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The canonical input columns and the categorical ones among them.
EXPECTED_COLUMNS = (
    "date",
    "daily_sales",
    "product_category",
    "marketing_spend",
    "day_of_week",
    "is_holiday",
)
CATEGORICAL_COLUMNS = ("product_category", "day_of_week")


@dataclass(frozen=True)
class PanelConfig:
    """Settings shared by every operator; override with ``PanelConfig(lag_days=(1, 7))``."""

    date_col: str = "date"
    target_col: str = "daily_sales"
    spend_col: str = "marketing_spend"
    holiday_col: str = "is_holiday"
    expected_columns: tuple[str, ...] = EXPECTED_COLUMNS
    categorical_columns: tuple[str, ...] = CATEGORICAL_COLUMNS
    # Default lags, windows, spans and accepted ranges.
    lag_days: tuple[int, ...] = (1, 7, 14, 28)
    rolling_windows: tuple[int, ...] = (7, 14, 28)
    ewm_spans: tuple[int, ...] = (7, 14, 28)
    min_sales: float = 0.0
    max_sales: float = 500_000.0
    min_spend: float = 0.0
    max_spend: float = 100_000.0
    date_format: str = "yyyy-MM-dd"
    # Tried in order after ``date_format``; the first that parses wins.
    fallback_date_formats: tuple[str, ...] = (
        "yyyy-MM-dd HH:mm:ss",
        "yyyy/MM/dd",
        "MM/dd/yyyy",
        "dd-MM-yyyy",
        "yyyyMMdd",
    )
    raw_dir: str = "data/raw"
    processed_dir: str = "data/processed"

    def __post_init__(self) -> None:
        for field in fields(self):
            value = getattr(self, field.name)
            if isinstance(value, list):
                object.__setattr__(self, field.name, tuple(value))

    def with_(self, **changes: Any) -> "PanelConfig":
        return replace(self, **changes)


DEFAULT = PanelConfig()

SALES_SCHEMA = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("daily_sales", T.DoubleType()),
        T.StructField("product_category", T.StringType()),
        T.StructField("marketing_spend", T.DoubleType()),
        T.StructField("day_of_week", T.StringType()),
        T.StructField("is_holiday", T.IntegerType()),
    ]
)


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] | list[str] = ()) -> list[str]:
    """Names of numeric columns in schema order (metadata only, no job)."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def resolve_target(df: DataFrame) -> str:
    """Target column: ``daily_sales``, else ``sales``, else a name holding "sales", else the first numeric."""
    names = df.columns
    for candidate in ("daily_sales", "sales"):
        if candidate in names:
            return candidate
    holding = [c for c in names if "sales" in c.lower()]
    candidates = holding or numeric_columns(df)
    if not candidates:
        raise ValueError("no numeric column can serve as the target")
    return candidates[0]
