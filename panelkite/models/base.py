"""What every model has in common: a fitted value, future calendars, intervals, persistence."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelkite.functions.scalars import MAD_TO_SIGMA, non_negative, z_value

FORECAST_FIELDS = ("model", "date", "day_number", "predicted", "lower_bound", "upper_bound")
MAX_HORIZON = 365


@dataclass
class Fitted:
    """A fitted model: one row of state per series, and for tree models the shared node table."""

    model: str
    keys: list[str]
    params: dict[str, Any]
    series: DataFrame
    nodes: DataFrame | None = None
    importances: DataFrame | None = None
    curve: DataFrame | None = None
    info: dict[str, Any] = field(default_factory=dict)

    def save(self, path: str) -> None:
        self.series.write.mode("overwrite").parquet(f"{path}/series")
        if self.nodes is not None:
            self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        extras = {name: frame for name in ("importances", "curve") if (frame := getattr(self, name)) is not None}
        for name, frame in extras.items():
            frame.write.mode("overwrite").parquet(f"{path}/{name}")
        meta = {
            "model": self.model, "keys": self.keys, "params": self.params, "nodes": self.nodes is not None,
            "extras": list(extras), "info": self.info,
        }
        spark = self.series.sparkSession
        spark.createDataFrame([(json.dumps(meta, default=str),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Fitted":
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        nodes = spark.read.parquet(f"{path}/nodes") if meta["nodes"] else None
        extras = {name: spark.read.parquet(f"{path}/{name}") for name in meta.get("extras", [])}
        return Fitted(
            meta["model"], meta["keys"], meta["params"], spark.read.parquet(f"{path}/series"), nodes, info=meta.get("info", {}), **extras
        )


def check_horizon(n_days: int, limit: int | None = MAX_HORIZON) -> int:
    if n_days < 1 or (limit is not None and n_days > limit):
        raise ValueError(f"horizon must lie between 1 and {limit}")
    return n_days


def future_calendar(series: DataFrame, n_days: int, last: str = "last_date") -> DataFrame:
    """``date, day_number`` for the days after ``last``; every row of ``series`` becomes n_days rows."""
    days = F.sequence(F.date_add(F.col(last), 1), F.date_add(F.col(last), n_days))
    return series.select("*", F.posexplode(days).alias("__i", "date")).select(
        *series.columns, "date", (F.col("__i") + 1).alias("day_number")
    )


def confidence_bounds(predicted: Column, sigma: Column, level: float = 0.95) -> tuple[Column, Column]:
    z = F.lit(z_value(level))
    return non_negative(predicted - z * sigma), predicted + z * sigma


def robust_sigma(
    residuals: DataFrame, keys: list[str], residual: str = "residual", name: str = "residual_std", carry: tuple[str, ...] = ()
) -> DataFrame:
    """1.4826 * median(|r - median(r)|) per series; a window and an aggregate over one exchange.

    ``carry`` names columns that are constant within a series and go along to the result.
    """
    group = W.partitionBy(*keys)
    centred = residuals.select(
        *keys, *carry, F.abs(F.col(residual) - F.percentile(residual, F.lit(0.5)).over(group)).alias("__d"))
    return centred.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in carry], (F.lit(MAD_TO_SIGMA) * F.percentile("__d", F.lit(0.5))).alias(name))


def points(n_days: int, value, last: str = "last_date") -> Column:
    """Array of ``date, day_number`` and the fields of ``value(day_number, date)`` for the days after ``last``.

    The horizon of a series stays in its row until the end, so a forecast moves no data.
    """

    def point(i: Column) -> Column:
        date = F.date_add(F.col(last), i)
        return F.struct(date.alias("date"), i.alias("day_number"), *[c.alias(n) for n, c in value(i, date).items()])

    return F.transform(F.sequence(F.lit(1), F.lit(n_days)), point)


def finish(
    series: DataFrame, keys: list[str], model: str, path: Column, level: float, include_ci: bool, native: bool = False
) -> DataFrame:
    """The long forecast frame from one row per series and its ``path`` of points.

    Bounds are the native ones of the points, or come from ``residual_std``; without that the fallback
    is a tenth of the mean prediction of the series.
    """
    rows = series.withColumn("__p", path)
    extra: list[Column] = []
    if include_ci and not native:
        total = F.aggregate("__p", F.lit(0.0), lambda a, p: a + non_negative(p["predicted"]))
        extra = [F.coalesce("residual_std", total / F.size("__p") * 0.1).alias("__sd")]
    rows = rows.select(*keys, *extra, F.inline("__p"))
    predicted, none = non_negative(F.col("predicted")), F.lit(None).cast("double")
    if not include_ci:
        lower, upper = none, none
    elif native:
        lower, upper = non_negative(F.col("lower_bound")), non_negative(F.col("upper_bound"))
    else:
        lower, upper = confidence_bounds(predicted, F.col("__sd"), level)
    return rows.select(
        *keys, F.lit(model).alias("model"), "date", F.col("day_number").cast("int").alias("day_number"),
        predicted.alias("predicted"), lower.alias("lower_bound"), upper.alias("upper_bound"),
    )
