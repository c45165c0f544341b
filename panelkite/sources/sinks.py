"""Writing sales, features, reports and forecasts. Every sink writes in parallel, one file per task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from panelkite.functions.calendar import short_day_name
from panelkite.sources.readers import STORED_COLUMNS


def import_sales(df: DataFrame, path: str, keys: list[str] | None = None) -> int:
    """Full refresh of the stored sales table; returns the number of rows written.

    Optional columns that are absent are written as NULL. Rows are range-partitioned by date and the
    series keys, so file statistics prune date bounds and one busy date spreads over its series. The
    rows are counted in the last stage of the writing job, where each partition counts once, however often a task is retried.
    """
    keys = keys or []
    types = {"date": "date", "is_holiday": "int", "product_category": "string"}
    cols = [
        (F.col(c) if c in df.columns else F.lit(None)).cast(types.get(c, "double")).alias(c)
        for c in STORED_COLUMNS
    ]
    out = df.select(*keys, *cols).repartitionByRange("date", *keys).sortWithinPartitions("date", *keys)
    seen = Observation()
    out.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    return seen.get.get("rows", 0)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    if by:
        writer = writer.partitionBy(*by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_csv(df: DataFrame, path: str) -> None:
    write_table(df, path, "csv")


def write_report(
    spark: SparkSession, path: str, initial_rows: int, final_rows: int, validation: DataFrame, features: DataFrame
) -> None:
    """JSON report: a summary line, then the validation rows and the feature rows beside it."""
    summary = spark.range(1).select(
        F.struct(
            F.lit(initial_rows).cast("long").alias("initial_rows"),
            F.lit(final_rows).cast("long").alias("final_rows"),
            F.lit(initial_rows - final_rows).cast("long").alias("rows_removed"),
        ).alias("pipeline_summary")
    )
    write_table(summary, f"{path}/summary", "json")
    write_table(validation, f"{path}/validation", "json")
    write_table(features, f"{path}/features", "json")


def write_forecasts_csv(forecasts: DataFrame, path: str) -> None:
    """The long forecast frame (all models, tagged by ``model``)."""
    write_csv(forecasts, path)


def write_importance_csv(importances: DataFrame, path: str) -> None:
    """``feature, importance``, largest first; at most one row per feature, hence one file."""
    out = importances.select(F.col("feature_name").alias("feature"), F.col("importance_score").alias("importance"))
    write_csv(out.orderBy(F.desc("importance"), "feature"), path)


def write_runs_json(runs: DataFrame, path: str) -> None:
    write_table(runs, path, "json")


def history_export(df: DataFrame) -> DataFrame:
    """Download form of the history: text NULLs empty, numeric NULLs 0."""
    return df.select(
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        F.coalesce("daily_sales", F.lit(0.0)).alias("daily_sales"),
        F.coalesce("marketing_spend", F.lit(0.0)).alias("marketing_spend"),
        F.coalesce("is_holiday", F.lit(0)).alias("is_holiday"),
    )


def forecast_export(df: DataFrame) -> DataFrame:
    """Download form of a forecast: date, weekday, value with two decimals."""
    return df.select(
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        short_day_name(F.col("date")).alias("weekday"),
        F.format_string("%.2f", "predicted").alias("value"),
    )
