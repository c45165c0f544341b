"""Paging, top-k, pivots and the display forms of history and forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelkite.functions.calendar import short_day_name
from panelkite.functions.keys import first_per
from panelkite.functions.scalars import contains_text
from panelkite.sources.readers import date_range


def paginate(
    df: DataFrame,
    order: list[str],
    offset: int = 0,
    limit: int | None = None,
    start: str | None = None,
    end: str | None = None,
    date_col: str = "date",
) -> DataFrame:
    """A page of the filtered, sorted history; each row also carries the total before paging."""
    kept = date_range(df, start, end, date_col)
    total = kept.agg(F.count("*").alias("n")).scalar()
    page = kept.orderBy(*order)
    if offset:
        page = page.offset(offset)
    if limit is not None:
        page = page.limit(limit)
    return page.withColumn("total", total)


def search_rows(df: DataFrame, term: str, columns: list[str] | None = None) -> DataFrame:
    return df.filter(contains_text(columns or df.columns, term))


def first_rows(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows per group; the optimizer also limits each group before the shuffle."""
    ranked = df.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col("__r") <= n).drop("__r")


def last_rows(df: DataFrame, keys: list[str], n: int, date_col: str = "date") -> DataFrame:
    return first_rows(df, keys, [F.desc(date_col)], n)


def latest_per(df: DataFrame, by: list[str], at: str = "created_at", tie: str | None = None) -> DataFrame:
    """The newest row per group, by a map-side combined maximum."""
    order = [F.col(at)] + ([F.col(tie)] if tie else [])
    return first_per(df, by, order, descending=True)


def pivot_forecasts(forecasts: DataFrame, keys: list[str], models: list[str]) -> DataFrame:
    """Date by model, with the model list given so that no extra job looks it up."""
    return forecasts.groupBy(*keys, "date").pivot("model", models).agg(F.first("predicted"))


def compare_forecasts(
    forecasts: DataFrame, keys: list[str], models: list[str], include_ci: bool = False
) -> DataFrame:
    """One column per model, and with ``include_ci`` also ``<model>_lower`` and ``<model>_upper``.

    Models are aligned on (keys, date) in one aggregate, no joins.
    """
    picks = []
    for m in models:
        here = F.col("model") == m
        picks.append(F.max(F.when(here, F.col("predicted"))).alias(m))
        if include_ci:
            picks.append(F.max(F.when(here, F.col("lower_bound"))).alias(f"{m}_lower"))
            picks.append(F.max(F.when(here, F.col("upper_bound"))).alias(f"{m}_upper"))
    return forecasts.groupBy(*keys, "date").agg(*picks)


def forecast_table(forecasts: DataFrame, keys: list[str]) -> DataFrame:
    """Weekday, share of the mean and interval width beside each forecast row."""
    mean = F.avg("predicted").over(W.partitionBy(*keys, "model"))
    return forecasts.select(
        *keys, "model", "date", "predicted",
        short_day_name(F.col("date")).alias("weekday"),
        (F.try_divide(F.col("predicted"), mean) * 100).alias("percent_of_mean"),
        (F.col("upper_bound") - F.col("lower_bound")).alias("ci_range"),
    )


def stitch(history: DataFrame, forecasts: DataFrame, keys: list[str], tail: int = 60, target: str = "daily_sales") -> DataFrame:
    """Last rows of the history, the last actual again as the anchor, then the forecast."""
    recent = history.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("date"))))
    recent = recent.filter(F.col("__r") <= tail)
    kinds = F.when(F.col("__r") == 1, F.array(F.lit("history"), F.lit("anchor"))).otherwise(F.array(F.lit("history")))
    past = recent.select(*keys, "date", F.col(target).alias("value"), F.explode(kinds).alias("kind"))
    ahead = forecasts.select(*keys, "date", F.col("predicted").alias("value"), F.lit("forecast").alias("kind"))
    return past.unionByName(ahead)


def flatten_insights(wide: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, insight_type, insight_key, insight_value`` (JSON text) from one column per type.

    A struct or map column gives a row per entry, anything else one row with the key ``value``.
    """
    entry = "array<struct<k:string,v:string>>"
    per_type = []
    for f in wide.schema:
        if f.name in keys:
            continue
        kind, c = f.dataType.typeName(), F.col(f.name)
        if kind == "struct":
            pairs = F.array(
                *[F.struct(F.lit(g.name).alias("k"), _json(c[g.name]).alias("v")) for g in f.dataType.fields]
            )
        elif kind == "map":
            pairs = F.transform(
                F.map_entries(c), lambda e: F.struct(e["key"].cast("string").alias("k"), _json(e["value"]).alias("v"))
            )
        else:
            pairs = F.array(F.struct(F.lit("value").alias("k"), _json(c).alias("v")))
        per_type.append(F.transform(pairs.cast(entry), _tag(f.name)))
    return wide.select(*keys, F.inline(F.flatten(F.array(*per_type))))


def _tag(name: str):
    return lambda e: F.struct(
        F.lit(name).alias("insight_type"), e["k"].alias("insight_key"), e["v"].alias("insight_value")
    )


def _json(c: Column) -> Column:
    """JSON text of any value: wrap it, print it, cut the wrapper off."""
    text = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(text, F.lit(6), F.length(text) - 6)


def zip_learning_curve(runs: DataFrame, by: list[str]) -> DataFrame:
    """``by, iteration, train_loss, val_loss`` from two arrays; a shorter validation array pads with NULL."""
    rows = runs.select(*by, "val_losses", F.posexplode("train_losses").alias("i", "train_loss"))
    return rows.select(
        *by, (F.col("i") + 1).alias("iteration"), "train_loss", F.get("val_losses", F.col("i")).alias("val_loss")
    )
