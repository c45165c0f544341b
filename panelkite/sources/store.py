"""The results store: append-only Parquet tables, one per kind of record.

An append never rewrites data; a repeated ``run_id`` is resolved on read, newest first. Model name is
the partition column, so model filters prune directories.
"""

from __future__ import annotations

from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelkite.operators.reshape import flatten_insights, latest_per, pivot_forecasts, zip_learning_curve

# The columns of each result table, beside the series keys; spans and sizes are named as in ``split_info``.
TABLES = {
    "training_runs": (
        "run_id string, model_name string, train_start date, train_end date, test_start date, test_end date, "
        "train_size long, test_size long, train_mape double, train_mae double, train_rmse double, "
        "test_mape double, test_mae double, test_rmse double, best_params string, training_time double, "
        "model_path string, created_at timestamp"
    ),
    "model_comparisons": (
        "comparison_id string, model_name string, rank int, test_mape double, test_mae double, test_rmse double, "
        "training_time double, created_at timestamp"
    ),
    "feature_importance": (
        "run_id string, model_name string, feature_name string, importance_score double, importance_rank int, "
        "created_at timestamp"
    ),
    "forecasts": (
        "forecast_id string, model_name string, forecast_date date, predicted_sales double, day_number int, "
        "lower_bound double, upper_bound double, level double, ci_method string, created_at timestamp"
    ),
    "eda_insights": (
        "analysis_id string, insight_type string, insight_key string, insight_value string, created_at timestamp"
    ),
    "learning_curves": (
        "run_id string, model_name string, iteration int, train_loss double, val_loss double, metric_type string, "
        "created_at timestamp"
    ),
}
NATIVE_CI = ("decomposable", "seasonal_arima")


class ResultsStore:
    """Typed access to the result tables under one root folder."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str] | None = None, key_types: str = "string"):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), keys or []
        self._key_ddl = "".join(f"{k} {key_types}, " for k in self.keys)

    def schema(self, name: str) -> str:
        return self._key_ddl + TABLES[name]

    def append(self, name: str, rows: DataFrame) -> None:
        """Append rows, columns that are missing as NULL, stamped now unless they carry a time."""
        empty = self.spark.createDataFrame([], self.schema(name))
        if "created_at" not in rows.columns:
            rows = rows.withColumn("created_at", F.current_timestamp())
        cols = [
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in empty.schema
        ]
        writer = rows.select(*cols).write.mode("append")
        if "model_name" in empty.columns:
            writer = writer.partitionBy("model_name")
        writer.parquet(f"{self.root}/{name}")

    def read(self, name: str, **equals: Any) -> DataFrame:
        """Rows matching every given column; NULL arguments are ignored. No table yet reads as empty."""
        empty = self.spark.createDataFrame([], self.schema(name))
        try:
            df = self.spark.read.schema(empty.schema).parquet(f"{self.root}/{name}").select(*empty.columns)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            df = empty
        for column, value in equals.items():
            if value is not None:
                df = df.filter(F.col(column) == F.lit(value))
        return df

    # --- training runs -----------------------------------------------------------------------

    def save_runs(self, runs: DataFrame) -> None:
        self.append("training_runs", runs)

    def runs(self, model_name: str | None = None) -> DataFrame:
        """One row per run and series (the newest if a run was saved again), newest first."""
        rows = self.read("training_runs", model_name=model_name)
        return latest_per(rows, [*self.keys, "run_id"]).orderBy(F.desc("created_at"))

    def latest_runs(self) -> DataFrame:
        return latest_per(self.read("training_runs"), [*self.keys, "model_name"], tie="run_id")

    def best_model(self) -> DataFrame:
        """Per series the run with the smallest test error."""
        runs = latest_per(self.read("training_runs"), [*self.keys, "run_id"])
        fields = ["model_name", "test_mape", "test_mae", "test_rmse", "best_params", "model_path"]
        pick = F.min_by(F.struct(*fields), F.struct("test_mape", "model_name"))
        out = runs.filter(F.col("test_mape").isNotNull()).groupBy(*self.keys).agg(pick.alias("b"))
        return out.filter(F.col("b").isNotNull()).select(*self.keys, "b.*")

    def metrics(self, target: float = 20.0) -> DataFrame:
        """Runs sorted by test error, parameters parsed, and whether the best meets the target."""
        runs = latest_per(self.read("training_runs"), [*self.keys, "run_id"])
        best = F.min("test_mape").over(W.partitionBy(*self.keys))
        parsed = F.from_json("best_params", "map<string,string>")
        return runs.withColumns({"best_params": parsed, "target_met": best <= target}).orderBy(
            F.asc_nulls_last("test_mape"), "model_name")

    def models(self, names: list[str]) -> DataFrame:
        """Every model name with its latest run, if any."""
        wanted = self.spark.createDataFrame([(n,) for n in names], "model_name string")
        return wanted.join(self.latest_runs(), "model_name", "left")

    # --- comparisons, importances, curves ----------------------------------------------------

    def save_comparison(self, comparison_id: str, results: DataFrame) -> None:
        w = W.partitionBy(*self.keys).orderBy(F.asc_nulls_last("test_mape"), "model_name")
        ranked = results.withColumns({"rank": F.row_number().over(w), "comparison_id": F.lit(comparison_id)})
        self.append("model_comparisons", ranked)

    def comparisons(self, comparison_id: str | None = None) -> DataFrame:
        return self.read("model_comparisons", comparison_id=comparison_id).orderBy(F.desc("created_at"), F.desc("comparison_id"), "rank")

    def save_importance(self, run_id: str, model_name: str, scores: DataFrame) -> None:
        """``feature_name, importance_score``; ranks by absolute score are added."""
        w = W.orderBy(F.desc(F.abs("importance_score")), "feature_name")
        ranked = scores.select("feature_name", "importance_score").withColumns(
            {"importance_rank": F.row_number().over(w), "run_id": F.lit(run_id), "model_name": F.lit(model_name)})
        self.append("feature_importance", ranked)

    def importance(self, model_name: str | None = None) -> DataFrame:
        return self.read("feature_importance", model_name=model_name).orderBy(F.desc("created_at"), F.desc("run_id"), "importance_rank")

    def latest_importance(self, model_name: str) -> DataFrame:
        rows = self.read("feature_importance", model_name=model_name)
        # Run ids carry no time: the newest is the one saved last.
        newest = rows.agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("r")).scalar()
        return rows.filter(F.col("run_id") == newest).orderBy("importance_rank")

    def save_learning_curve(self, run_id: str, model_name: str, curve: DataFrame, metric_type: str = "rmse") -> None:
        """A curve as rows (``iteration, train_loss, val_loss``) or as two arrays."""
        if "train_losses" in curve.columns:
            curve = zip_learning_curve(curve, [])
        tags = {"run_id": run_id, "model_name": model_name, "metric_type": metric_type}
        self.append("learning_curves", curve.withColumns({k: F.lit(v) for k, v in tags.items()}))

    def learning_curve(self, run_id: str | None = None, model_name: str | None = None) -> DataFrame:
        rows = self.read("learning_curves", run_id=run_id, model_name=model_name)
        return rows.orderBy(F.desc("created_at"), F.desc("run_id"), "iteration")

    # --- forecasts ---------------------------------------------------------------------------

    def save_forecasts(self, forecast_id: str, forecasts: DataFrame, level: float = 0.95) -> None:
        """Append the long forecast frame with its bounds, their level and how they were made."""
        method = (
            F.when(F.col("model").isin(*NATIVE_CI), "native").when(F.col("model") == "ensemble", "ensemble").otherwise("mad")
        )
        rows = forecasts.select(
            *self.keys, F.lit(forecast_id).alias("forecast_id"), F.col("model").alias("model_name"),
            F.col("date").alias("forecast_date"), F.col("predicted").alias("predicted_sales"), "day_number",
            "lower_bound", "upper_bound", F.lit(level).alias("level"), method.alias("ci_method"))
        self.append("forecasts", rows)

    def forecasts(self, model_name: str | None = None, forecast_id: str | None = None) -> DataFrame:
        rows = self.read("forecasts", model_name=model_name, forecast_id=forecast_id)
        return rows.orderBy(F.desc("created_at"), F.desc("forecast_id"), "day_number")

    def forecast_ids(self) -> DataFrame:
        """Distinct ids, newest first."""
        rows = self.read("forecasts").groupBy("forecast_id").agg(F.max("created_at").alias("created_at"))
        return rows.orderBy(F.desc("created_at"), F.desc("forecast_id"))

    def latest_forecast_id(self) -> str | None:
        row = self.forecast_ids().first()
        return row["forecast_id"] if row else None

    def _of(self, forecast_id: str | None) -> DataFrame:
        return self.read("forecasts", forecast_id=forecast_id or self.latest_forecast_id() or "")

    def forecast_comparison(self, models: list[str], forecast_id: str | None = None) -> DataFrame:
        rows = self._of(forecast_id).select(
            *self.keys, F.col("forecast_date").alias("date"), F.col("model_name").alias("model"),
            F.col("predicted_sales").alias("predicted"))
        return pivot_forecasts(rows, self.keys, models)

    def forecast_summary(self, forecast_id: str | None = None) -> DataFrame:
        return stored_forecast_summary(self._of(forecast_id), [*self.keys, "forecast_id", "model_name"])

    # --- insights ----------------------------------------------------------------------------

    def save_insights(self, analysis_id: str, wide: DataFrame) -> None:
        """One column per insight type: a struct or map is flattened to keys, a scalar gets the key ``value``."""
        rows = flatten_insights(wide, self.keys).withColumn("analysis_id", F.lit(analysis_id))
        self.append("eda_insights", rows)

    def insights(self, analysis_id: str | None = None) -> DataFrame:
        return self.read("eda_insights", analysis_id=analysis_id).orderBy(F.desc("created_at"), "insight_type", "insight_key")


def stored_forecast_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Days, span, total, mean, range and population deviation per group."""
    p = "predicted_sales"
    return rows.groupBy(*by).agg(
        F.max("day_number").alias("n_days"), F.min("forecast_date").alias("start"), F.max("forecast_date").alias("end"),
        F.sum(p).alias("total"), F.avg(p).alias("mean"), F.min(p).alias("min"), F.max(p).alias("max"),
        F.stddev_pop(p).alias("std"))
