"""Calendar expressions over a date column. All are plain JVM expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weekday names in Monday-first order.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

# Period lengths of the cyclical encodings.
CYCLES = {"day_of_week": 7, "month": 12, "day_of_year": 365, "week_of_year": 52}


def flag(condition: Column) -> Column:
    return condition.cast("int")


# Fixed values, in the functions below: the names of the calendar features.


def minimal_date(d: Column) -> dict[str, Column]:
    return {
        "day_of_week_num": F.weekday(d),
        "month": F.month(d),
        "quarter": F.quarter(d),
        "day_of_year": F.dayofyear(d),
        "is_weekend": flag(F.weekday(d) >= 5),
    }


def full_date(d: Column) -> dict[str, Column]:
    month, month_end = F.month(d), F.last_day(d)
    return {
        "year": F.year(d),
        "month": month,
        "day": F.dayofmonth(d),
        "quarter": F.quarter(d),
        "day_of_week_num": F.weekday(d),
        "day_of_year": F.dayofyear(d),
        "week_of_year": F.weekofyear(d),
        "is_weekend": flag(F.weekday(d) >= 5),
        "is_month_start": flag(F.dayofmonth(d) == 1),
        "is_month_end": flag(d == month_end),
        "is_quarter_start": flag(d == F.trunc(d, "quarter")),
        "is_quarter_end": flag((d == month_end) & (month % 3 == 0)),
        "is_year_start": flag(F.dayofyear(d) == 1),
        "is_year_end": flag((d == month_end) & (month == 12)),
        "days_in_month": F.dayofmonth(month_end),
    }


def cyclical(d: Column, names: tuple[str, ...] = tuple(CYCLES)) -> dict[str, Column]:
    position = {
        "day_of_week": F.weekday(d),
        "month": F.month(d),
        "day_of_year": F.dayofyear(d),
        "week_of_year": F.weekofyear(d),
    }
    out: dict[str, Column] = {}
    for name in names:
        angle = F.lit(2 * math.pi) * position[name] / F.lit(CYCLES[name])
        out[f"{name}_sin"] = F.sin(angle)
        out[f"{name}_cos"] = F.cos(angle)
    return out


def day_name(d: Column) -> Column:
    return F.date_format(d, "EEEE")


def short_day_name(d: Column) -> Column:
    return F.date_format(d, "EEE")


def month_key(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def weekday_indicators(d: Column) -> dict[str, Column]:
    """Seven 0/1 columns, none dropped."""
    return {f"dow_{i}": (F.weekday(d) == i).cast("double") for i in range(7)}


def add_columns(df, exprs: dict[str, Column]):
    return df.select(*[c for c in df.columns if c not in exprs], *[e.alias(n) for n, e in exprs.items()])
