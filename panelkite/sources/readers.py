"""Reading sales records from CSV, Parquet, ORC, JSON or a catalog table."""

from __future__ import annotations

import os
from datetime import date
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from panelkite.config import DEFAULT, PanelConfig

STORED_COLUMNS = ("date", "daily_sales", "marketing_spend", "is_holiday", "product_category")


def parse_date(c: Column, cfg: PanelConfig = DEFAULT) -> Column:
    """The configured format, then the fallbacks, then NULL. Never raises, also under ANSI mode."""
    text = F.trim(c.cast("string"))
    return F.coalesce(*[F.try_to_date(text, f) for f in (cfg.date_format, *cfg.fallback_date_formats)])


def _by_header(spark: SparkSession, path: str, corrupt_column: str | None) -> DataFrame:
    """All files under ``path`` as text columns, each file by its own header."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    raw = reader.csv(path)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    # A file's first block lies in one task, in order: the first line that is met there is the header.
    headers = lines.filter("at = 0").groupBy("file").agg(F.first("value").alias("header")).collect()
    groups: dict[str, list[str]] = {}
    for row in headers:
        groups.setdefault(row["header"], []).append(row["file"])
    if len(groups) < 2 and not corrupt_column:
        return raw
    parts = []
    for header in sorted(groups):
        part = reader.csv(sorted(groups[header]))
        if corrupt_column:
            schema = part.schema.add(corrupt_column, "string")
            # All columns are parsed: with fewer, a line is held against the chosen ones alone and passes as whole.
            part = reader.schema(schema).option("columnNameOfCorruptRecord", corrupt_column).option(
                "columnPruning", False).csv(sorted(groups[header]))
        parts.append(part)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else raw


def read_csv(
    spark: SparkSession,
    path: str,
    cfg: PanelConfig = DEFAULT,
    parse_dates: bool = True,
    on_bad_date: str = "null",
    require_rows: bool = False,
    corrupt_column: str | None = None,
) -> DataFrame:
    """Headed CSV with typed measures; unreadable numbers become NULL.

    Columns are read as text by header name: files whose headers differ in order or content are read
    apart and joined by name, so a missing or extra column is never fatal here. ``corrupt_column`` keeps
    the whole line of rows that do not fit their header.
    ``on_bad_date`` is ``null``, ``drop`` or ``raise`` (the job fails on the first bad date).
    """
    try:
        raw = _by_header(spark, path, corrupt_column)
    except AnalysisException as error:
        raise FileNotFoundError(f"cannot read CSV {path}: {error.getCondition()}") from error
    typed = coerce_types(raw, cfg)
    if parse_dates and cfg.date_col in raw.columns:
        parsed = parse_date(F.col(cfg.date_col), cfg)
        bad = F.col(cfg.date_col).isNotNull() & parsed.isNull()
        if on_bad_date == "raise":
            message = F.concat(F.lit("unparsable date: "), F.col(cfg.date_col))
            parsed = F.when(bad, F.raise_error(message).cast("date")).otherwise(parsed)
        elif on_bad_date == "drop":
            typed = typed.filter(~bad)
        elif on_bad_date != "null":
            raise ValueError("on_bad_date must be null, drop or raise")
        typed = typed.withColumn(cfg.date_col, parsed)
    if require_rows and typed.isEmpty():
        raise ValueError(f"CSV {path} holds no rows")
    return typed


def coerce_types(df: DataFrame, cfg: PanelConfig = DEFAULT) -> DataFrame:
    """Measures to double and the holiday flag to a nullable int; text that does not parse becomes NULL."""
    exprs = []
    for name in df.columns:
        c = F.col(name)
        if name in (cfg.target_col, cfg.spend_col):
            c = c.try_cast("double").alias(name)
        elif name == cfg.holiday_col:
            c = c.try_cast("double").try_cast("int").alias(name)
        exprs.append(c)
    return df.select(*exprs)


def read_sales(
    spark: SparkSession,
    source: str,
    path: str,
    start: str | date | None = None,
    end: str | date | None = None,
    cfg: PanelConfig = DEFAULT,
) -> DataFrame:
    """Dispatch on the source kind; the optional inclusive date bounds reach columnar file scans."""
    if source == "csv":
        df = read_csv(spark, path, cfg)
    elif source in ("parquet", "orc", "json"):
        df = spark.read.format(source).load(path)
    elif source in ("table", "database"):
        df = spark.read.table(path)
    else:
        raise ValueError(f"unknown source {source!r}: use csv, parquet, orc, json or table")
    return date_range(df, start, end, cfg.date_col)


def read_raw(spark: SparkSession, filename: str, cfg: PanelConfig = DEFAULT) -> DataFrame:
    return read_csv(spark, os.path.join(cfg.raw_dir, filename), cfg)


def date_range(
    df: DataFrame, start: str | date | None = None, end: str | date | None = None, date_col: str = "date"
) -> DataFrame:
    """Inclusive bounds, each optional. The last day is whole, also for a column of timestamps."""
    if start is not None:
        df = df.filter(F.col(date_col) >= F.lit(str(start)).cast("date"))
    if end is not None:
        last = F.lit(str(end)).cast("date")
        by_day = isinstance(df.schema[date_col].dataType, DateType)
        df = df.filter(F.col(date_col) <= last if by_day else F.col(date_col) < F.date_add(last, 1))
    return df


def load_sales(spark: SparkSession, path: str) -> DataFrame:
    """The stored sales table in date order. Windows carry their own order; this sort is for output."""
    stored = spark.read.parquet(path)
    keys = [c for c in stored.columns if c not in STORED_COLUMNS]
    return stored.select(*keys, *STORED_COLUMNS).orderBy("date", *keys)
