"""Named queries over the driver tables: one per operator or family of operators.

Each takes ``(spark, base)`` and returns a lazy DataFrame over the whole tables. Doubles are rounded
for comparison with the SQL of :mod:`panelkite.plans.oracles`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkite.functions import calendar as cal
from panelkite.functions import windows as win
from panelkite.functions import longseries
from panelkite.functions.keys import attach, series_window
from panelkite.functions.scalars import contains_text, strip_param_prefix
from panelkite.models import arima, decomposable, ensemble, linear, registry, search, trees
from panelkite.models import base as base_model
from panelkite.operators import cleaning, eda, features, metrics, quality, report, reshape, sessions, splits
from panelkite.operators.quantiles import exact_quantiles
from panelkite.config import DEFAULT, resolve_target
from panelkite.plans import forecasting, training
from panelkite.session import new_path, written
from panelkite.sources import sinks
from panelkite.sources.panel import daily_panel, event_panel, table
from panelkite.sources.readers import date_range, load_sales, read_csv, read_raw, read_sales
from panelkite.sources.store import ResultsStore
from panelkite.streaming import intake, state
from panelkite.streaming import sessions as stream

SEG = ["c_mktsegment"]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def places(name: str, dp: int) -> int:
    """Decimal places by column, chosen so that no value sits on a rounding tie.

    Spend, deviations, means and bounds lie on a finer grid than four places can hold.
    """
    if name == "mse":
        return 0
    if "ewm" in name:
        return min(dp, 3)
    if "spend" in name or "deviation" in name or (dp == 4 and ("mean" in name or "bound" in name or "avg" in name)):
        return max(dp, 6)
    return dp


def rounded(df: DataFrame, dp: int = 4) -> DataFrame:
    return df.select(*[F.round(c, places(c, dp)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def longs(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in df.dtypes])


def zoneless(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


def show(df: DataFrame, dp: int = 4) -> DataFrame:
    return zoneless(longs(rounded(df, dp)))


def panel(spark: SparkSession, base: str) -> DataFrame:
    return daily_panel(spark, base, SEG)


def sales(spark: SparkSession, base: str) -> DataFrame:
    """The panel without the spend column: skips the line-item scan."""
    return daily_panel(spark, base, SEG, with_spend=False).drop("marketing_spend")


def raw_sales(spark: SparkSession, base: str) -> DataFrame:
    """One row per order with the defects the quality operators look for, derived from order columns."""
    o = table(spark, base, "orders")
    c = table(spark, base, "customer")
    low = F.col("o_orderpriority").startswith("5")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        "c_mktsegment",
        F.when(F.col("o_totalprice") > 1000, F.to_date("o_orderdate")).alias("date"),
        F.when(~(low & (F.col("o_orderstatus") == "F")), F.col("o_totalprice") - 2000).alias("daily_sales"),
        F.when(F.col("o_orderstatus") != "O", "open").alias("product_category"),
        F.col("o_totalprice").alias("marketing_spend"),
        F.col("o_orderpriority").substr(1, 1).cast("int").alias("is_holiday"),
    )


def gappy(spark: SparkSession, base: str) -> DataFrame:
    """The panel with NULLs at month starts (measures) and weekends (category)."""
    p = panel(spark, base)
    first = F.dayofmonth("date") <= 2
    return p.select(
        *SEG, "date",
        F.when(~first, F.col("daily_sales")).alias("daily_sales"),
        F.when(~first, F.col("marketing_spend")).alias("marketing_spend"),
        F.when(F.weekday("date") < 5, cal.day_name(F.col("date"))).alias("product_category"),
    )


# --- panels, scans, summaries ---------------------------------------------------------------


@query
def daily_panel_by_segment(spark, base):
    return show(panel(spark, base))


@query
def daily_panel_by_region(spark, base):
    return show(daily_panel(spark, base, ["r_name", "n_name"]))


@query
def daily_event_panel(spark, base):
    return show(event_panel(spark, base))


@query
def table_summary(spark, base):
    return show(eda.table_summary(sales(spark, base)))


@query
def history_summary(spark, base):
    return eda.history_summary(sales(spark, base), SEG)


@query
def date_range_scan(spark, base):
    """Both bounds reach the order scan as pushed filters."""
    rows = table(spark, base, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    kept = date_range(rows, "1996-01-01", "1996-12-31", "o_orderdate")
    return show(kept.select("o_orderkey", F.to_date("o_orderdate").alias("date"), "o_totalprice"))


@query
def timestamp_range_scan(spark, base):
    """The last day of a timestamp column is whole."""
    kept = date_range(table(spark, base, "events"), "2024-01-02", "2024-01-05", "ts")
    return kept.groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@query
def csv_scan(spark, base):
    """Files whose columns stand in another order, one with a column more, read by header name."""
    path = new_path(spark, "csv")
    rows = table(spark, base, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_totalprice").alias("daily_sales"),
        (F.col("o_orderkey") % 7).cast("double").alias("marketing_spend"), "o_orderkey")
    odd = F.col("o_orderkey") % 2 == 1
    rows.filter(odd).drop("o_orderkey").write.option("header", True).csv(path)
    rows.filter(~odd).select("marketing_spend", "date", "o_orderkey", "daily_sales").write.mode("append").option("header", True).csv(path)
    got = read_csv(spark, path)
    return show(got.groupBy("marketing_spend").agg(
        F.count("*").alias("n"), F.count("o_orderkey").alias("keys"), F.sum("daily_sales").alias("sales"),
        F.min("date").alias("first_date")), 2)


@query
def csv_corrupt_rows(spark, base):
    """Lines with a field too many are kept whole beside the rows that fit their header."""
    path = new_path(spark, "csv")
    spend = F.when(F.col("o_orderkey") % 10 == 0, F.lit("5,7")).otherwise((F.col("o_orderkey") % 7).cast("string"))
    lines = F.concat_ws(",", F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderkey", spend)
    whole = table(spark, base, "orders").select(lines.alias("date,daily_sales,marketing_spend"))
    whole.write.option("header", True).option("sep", "\t").csv(path)
    got = read_csv(spark, path, corrupt_column="line")
    return show(got.groupBy("date", F.col("line").isNotNull().alias("is_corrupt")).agg(
        F.count("*").alias("n"), F.sum("daily_sales").alias("sales"), F.max("line").alias("last_line")))


@query
def dedup_null_rows(spark, base):
    """A known value is kept before a missing one of the same date."""
    rows = panel(spark, base).select(*SEG, "date", "daily_sales")
    doubled = rows.unionByName(rows.withColumn("daily_sales", F.lit(None).cast("double")))
    return show(cleaning.drop_duplicates(doubled, SEG))


@query
def history_export(spark, base):
    return show(sinks.history_export(gappy(spark, base).withColumn("is_holiday", F.lit(None).cast("int"))))


# --- calendar and scalar features ------------------------------------------------------------


@query
def calendar_features(spark, base):
    p = sales(spark, base).select(*SEG, "date")
    d = F.col("date")
    named = cal.full_date(d) | {"day_name": cal.day_name(d), "short_day": cal.short_day_name(d), "month_key": cal.month_key(d)}
    return show(cal.add_columns(p, named))


@query
def cyclical_features(spark, base):
    p = sales(spark, base).select(*SEG, "date")
    return show(cal.add_columns(p, cal.cyclical(F.col("date"))), 9)


@query
def weekday_one_hot(spark, base):
    p = sales(spark, base).select(*SEG, "date")
    return show(cal.add_columns(p, cal.weekday_indicators(F.col("date"))))


@query
def trend_scalars(spark, base):
    p = sales(spark, base).select(*SEG, "date")
    return show(cal.add_columns(p, features.trend_scalars(SEG)), 9)


@query
def interaction_features(spark, base):
    p = panel(spark, base)
    means = {"daily_sales_rolling_mean_7", "daily_sales_rolling_mean_28"}
    exprs = features.interaction_features(p, SEG, means)
    return show(p.select(*SEG, "date", *[e.alias(n) for n, e in exprs.items()]))


@query
def minimal_features(spark, base):
    return show(features.create_features(panel(spark, base), SEG, "minimal").drop("product_category"))


@query
def full_features(spark, base):
    return show(features.create_features(panel(spark, base), SEG, "full").drop("product_category"))


@query
def feature_null_summary(spark, base):
    p = panel(spark, base)
    made = features.create_features(p, SEG, "minimal")
    return show(features.feature_summary(made, features.feature_names(p, made), SEG))


@query
def complete_feature_rows(spark, base):
    made = features.create_features(panel(spark, base), SEG, "minimal")
    return show(features.drop_null_rows(made).select(*SEG, "date", "daily_sales_lag_7"))


@query
def row_search(spark, base):
    p = sales(spark, base)
    return show(p.filter(contains_text(["c_mktsegment", "date"], "mach")).select(*SEG, "date", "daily_sales"))


# --- windows ---------------------------------------------------------------------------------


@query
def lag_diff_pct(spark, base):
    p, w, y = panel(spark, base), series_window(SEG), F.col("daily_sales")
    lags = {f"sales_lag_{k}": win.lag(y, k, w) for k in (1, 7, 14, 28)}
    lags |= {f"spend_lag_{k}": win.lag(F.col("marketing_spend"), k, w) for k in (1, 7, 14, 28)}
    for k in (1, 7):
        lags |= {f"diff_{k}": win.diff(y, k, w), f"pct_{k}": win.pct_change(y, k, w)}
    return show(p.select(*SEG, "date", *[e.alias(n) for n, e in lags.items()]))


@query
def period_ratio(spark, base):
    p = sales(spark, base)
    return show(p.select(*SEG, "date", *[e.alias(n) for n, e in features.ratio_features(SEG).items()]))


@query
def rolling_stats(spark, base):
    p, w, y = sales(spark, base), series_window(SEG), F.col("daily_sales")
    stats = [s for s in win.ROLLING if s != "median"]
    return show(p.select(*SEG, "date", *[win.rolling(y, s, n, w).alias(f"{s}_{n}") for n in (7, 14, 28) for s in stats]))


@query
def rolling_median(spark, base):
    p, w, y = sales(spark, base), series_window(SEG), F.col("daily_sales")
    return show(p.select(*SEG, "date", *[win.rolling(y, "median", n, w).alias(f"median_{n}") for n in (7, 14, 28)]))


@query
def strict_rolling(spark, base):
    p, w, y = sales(spark, base), series_window(SEG), F.col("daily_sales")
    cols = [win.strict_rolling(y, s, n, w).alias(f"{s}_{n}") for n in (7, 14) for s in ("mean", "std")]
    return show(p.select(*SEG, "date", *cols))


@query
def moving_average(spark, base):
    return show(eda.moving_averages(sales(spark, base).select(*SEG, "date", "daily_sales"), SEG))


@query
def ewm_mean(spark, base):
    p = sales(spark, base).select(*SEG, "date", "daily_sales")
    return show(win.with_ewm(p, SEG, "date", "daily_sales", (7, 14, 28), "ewm_"))


@query
def day_number_and_gap(spark, base):
    p, w = sales(spark, base), series_window(SEG)
    return show(p.select(*SEG, "date", win.position(w).alias("day_number"), win.gap_days("date", w).alias("gap_days")))


# --- quality and cleaning --------------------------------------------------------------------


@query
def validation_report(spark, base):
    found = quality.validate(written(raw_sales(spark, base), "raw"), SEG)
    return show(found.filter(~F.col("check").isin("schema", "type")).select(*SEG, "check", "severity", "column", "count", "pct"))


@query
def validation_summary(spark, base):
    raw = written(raw_sales(spark, base), "raw")
    return show(quality.validation_summary(quality.validate(raw, SEG), raw, SEG))


@query
def missing_values(spark, base):
    return show(quality.missing_values(raw_sales(spark, base), SEG))


@query
def date_gaps(spark, base):
    return show(quality.date_gaps(sales(spark, base), SEG))


@query
def duplicate_rows(spark, base):
    items = table(spark, base, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax")
    return show(quality.duplicate_rows(items, ["l_returnflag"]))


@query
def duplicate_dates(spark, base):
    return show(quality.duplicate_dates(raw_sales(spark, base), SEG))


@query
def exact_quantiles_rows(spark, base):
    """Row-level quantiles where each of three groups holds about a third of all rows."""
    items = table(spark, base, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity")
    return show(exact_quantiles(items, ["l_returnflag"], ["l_extendedprice", "l_quantity"], (0.05, 0.25, 0.5, 0.75, 0.99)))


@query
def iqr_outliers_rows(spark, base):
    items = table(spark, base, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity")
    return show(quality.iqr_outliers(items, ["l_returnflag"], ["l_extendedprice", "l_quantity"]), 6)


@query
def iqr_outliers_sketched(spark, base):
    """Quartiles from one pass of sketches, here finer than a rank of any group, so that SQL can say them."""
    items = table(spark, base, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity")
    return show(quality.iqr_outliers(items, ["l_returnflag"], ["l_extendedprice", "l_quantity"], accuracy=10_000_000), 6)


@query
def summary_statistics(spark, base):
    return show(quality.summary_statistics(raw_sales(spark, base), SEG).drop("total_columns"))


@query
def data_info(spark, base):
    return show(quality.data_info(raw_sales(spark, base)).drop("dtype"))


@query
def quality_report(spark, base):
    return show(quality.quality_report(written(raw_sales(spark, base), "raw"), SEG))


@query
def quality_check(spark, base):
    return show(quality.quality_check(raw_sales(spark, base), SEG))


@query
def upload_check(spark, base):
    raw = raw_sales(spark, base)
    text = raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns])
    return show(quality.upload_check(text.drop("c_mktsegment")).drop("missing_columns", "columns"))


@query
def fill_forward_backward(spark, base):
    g = gappy(spark, base).drop("product_category")
    return show(cleaning.fill_numeric(g, SEG, ["daily_sales", "marketing_spend"]))


@query
def fill_mode(spark, base):
    return show(cleaning.fill_mode(gappy(spark, base), SEG, ["product_category"]).select(*SEG, "date", "product_category"))


@query
def keep_first_per_date(spark, base):
    o, c = table(spark, base, "orders"), table(spark, base, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey).select(
        "c_mktsegment", F.to_date("o_orderdate").alias("date"), "o_orderkey", "o_totalprice")
    return show(cleaning.drop_duplicates(rows, SEG, [F.col("o_orderkey")]))


@query
def clean_sales(spark, base):
    raw = raw_sales(spark, base).select("c_mktsegment", "date", "daily_sales", "marketing_spend", "is_holiday", "product_category")
    return show(cleaning.clean(raw, SEG))


@query
def clip_outliers(spark, base):
    return show(cleaning.handle_outliers(panel(spark, base).drop("product_category"), SEG, n_std=2.0))


@query
def remove_outliers(spark, base):
    return show(cleaning.handle_outliers(panel(spark, base).drop("product_category"), SEG, method="remove", n_std=2.0))


@query
def parsed_text_rows(spark, base):
    """The panel as text under untidy headers, named, parsed and typed again; a few cells do not parse."""
    p = panel(spark, base)
    bad = F.dayofmonth("date") == 13
    text = p.select(
        F.col("c_mktsegment").alias("C MktSegment"),
        F.when(F.month("date") % 2 == 0, F.date_format("date", "yyyy/MM/dd")).otherwise(F.date_format("date", "yyyy-MM-dd")).alias(" Date "),
        F.when(bad, F.lit("n/a")).otherwise(F.col("daily_sales").cast("string")).alias("Daily Sales"),
        F.col("is_holiday").cast("string").alias("Is Holiday"))
    named = cleaning.standardize_names(text)
    return show(cleaning.coerce_types(cleaning.parse_dates(named)))


@query
def cleaning_report(spark, base):
    raw = raw_sales(spark, base)
    return show(cleaning.cleaning_report(raw, cleaning.clean(raw, SEG), SEG))


# --- exploratory statistics ------------------------------------------------------------------


@query
def basic_stats(spark, base):
    return show(eda.basic_stats(sales(spark, base), SEG))


@query
def trend(spark, base):
    return show(eda.trend(sales(spark, base), SEG, p_value=False))


@query
def trend_significance(spark, base):
    """Adds the Student-t tail, which the SQL integrates numerically."""
    return show(eda.trend(sales(spark, base), SEG), 6)


@query
def trend_residuals(spark, base):
    return show(eda.trend_residuals(sales(spark, base).select(*SEG, "date", "daily_sales"), SEG), 3)


@query
def monthly_averages(spark, base):
    return show(eda.monthly_averages(sales(spark, base), SEG), 6)


@query
def weekday_profile(spark, base):
    return show(eda.weekday_profile(sales(spark, base), SEG))


@query
def weekday_summary(spark, base):
    return show(eda.weekday_summary(sales(spark, base), SEG))


@query
def month_quarter_profile(spark, base):
    out = eda.season_profile(sales(spark, base), SEG)
    return show(out.withColumns({c: F.col(c).cast("int") for c in ("is_best", "is_worst")}), 6)


@query
def holiday_effect(spark, base):
    return show(eda.holiday_effect(sales(spark, base), SEG))


@query
def autocorrelation(spark, base):
    return show(eda.autocorrelation(sales(spark, base), SEG, (1, 7, 14, 30)), 7)


@query
def acf_curve(spark, base):
    return show(eda.acf(sales(spark, base), SEG, 60), 7)


@query
def target_correlations(spark, base):
    made = features.create_features(panel(spark, base), SEG, "minimal")
    cols = ["marketing_spend", "is_holiday", "day_of_week_num", "month", "daily_sales_lag_1", "daily_sales_rolling_mean_7"]
    return show(eda.target_correlations(made, SEG, cols), 7)


@query
def correlation_matrix(spark, base):
    made = features.create_features(panel(spark, base), SEG, "minimal")
    return show(eda.correlation_matrix(made, SEG, ["daily_sales", "marketing_spend", "daily_sales_lag_1", "day_of_week_num"]), 7)


@query
def long_series_windows(spark, base):
    """All events as one series of any length: lags, ratios and rolling statistics without a window over the whole table."""
    value = F.col("value")

    def columns(w, pos):
        return {
            "pos": pos, "lag_1": win.lag(value, 1, w), "lag_28": win.lag(value, 28, w), "diff_7": win.diff(value, 7, w),
            "pct_1": win.pct_change(value, 1, w), "mean_7": win.rolling(value, "mean", 7, w),
            "std_28": win.strict_rolling(value, "std", 28, w), "max_14": win.rolling(value, "max", 14, w),
            "ma_7": win.moving_average(value, 7, w),
        }

    events = table(spark, base, "events").select("event_id", "ts", "value")
    return show(longseries.long_windows(events, [], ["ts", "event_id"], columns, reach=28, bucket_rows=5_000).drop("ts"), 5)


@query
def wide_correlation_matrix(spark, base):
    """Thirty lags of each series, unknown at its start: 435 pairs, each over the days on which both are known."""
    p, w = sales(spark, base), series_window(SEG)
    lagged = p.select(*SEG, *[F.lag("daily_sales", k).over(w).alias(f"lag_{k}") for k in range(30)])
    return show(eda.correlation_matrix(lagged, SEG, [f"lag_{k}" for k in range(30)]), 7)


@query
def outlier_counts(spark, base):
    return show(eda.outliers(sales(spark, base), SEG), 6)


@query
def histogram(spark, base):
    return show(eda.histogram(sales(spark, base), SEG, 30))


@query
def boxplot_stats(spark, base):
    return show(eda.boxplot_stats(sales(spark, base), SEG))


@query
def boxplot_fliers(spark, base):
    return show(eda.boxplot_fliers(sales(spark, base), SEG))


@query
def qq_points(spark, base):
    return show(eda.qq_points(sales(spark, base), SEG))


@query
def series_analysis(spark, base):
    out = report.analysis(panel(spark, base), SEG)
    return show(out.drop("weekday_means", "correlations"))


@query
def key_insights(spark, base):
    return show(report.insights(report.analysis(panel(spark, base), SEG), SEG))


@query
def section_report(spark, base):
    return show(report.section_report(report.analysis(panel(spark, base), SEG), SEG))


@query
def tidy_analysis(spark, base):
    """The analysis bundle in long form: one row per series, section and figure."""
    p = sales(spark, base)
    parts = [("basic_stats", eda.basic_stats(p, SEG)), ("trend", eda.trend(p, SEG, p_value=False)),
             ("holiday_effect", eda.holiday_effect(p, SEG)), ("autocorrelation", eda.autocorrelation(p, SEG)),
             ("outliers", eda.outliers(p, SEG))]
    return show(reduce(DataFrame.unionByName, [report.tidy(w, SEG, name) for name, w in parts]), 5)


@query
def top_correlations(spark, base):
    made = features.create_features(panel(spark, base), SEG, "minimal")
    cols = ["marketing_spend", "is_holiday", "day_of_week_num", "month", "daily_sales_lag_1", "daily_sales_rolling_mean_7"]
    return show(eda.target_correlations(made, SEG, cols).filter(F.col("rank") <= 3), 7)


# --- splits and metrics ----------------------------------------------------------------------


def naive_predictions(spark, base):
    """Lag-based predictions under the names of models, one long frame of (actual, predicted)."""
    p, w = sales(spark, base), series_window(SEG)
    lagged = p.select(*SEG, "date", F.col("daily_sales").alias("actual"),
                      *[F.lag("daily_sales", k).over(w).alias(f"naive_{k}") for k in (1, 7, 14, 28)])
    rows = lagged.unpivot([*SEG, "date", "actual"], [f"naive_{k}" for k in (1, 7, 14, 28)], "model_name", "predicted")
    return rows.filter(F.col("predicted").isNotNull())


@query
def simple_split(spark, base):
    s = splits.simple_split(sales(spark, base), SEG, 0.8)
    return show(splits.split_info(s, SEG))


@query
def walk_forward_split(spark, base):
    return show(splits.split_info(splits.walk_forward_split(sales(spark, base), SEG, 5), SEG))


@query
def walk_forward_rows(spark, base):
    return show(splits.walk_forward_split(sales(spark, base).select(*SEG, "date"), SEG, 5))


@query
def sliding_window_split(spark, base):
    return show(splits.split_info(splits.sliding_window_split(sales(spark, base), SEG, 5), SEG))


@query
def regression_metrics(spark, base):
    return show(metrics.regression_metrics(naive_predictions(spark, base), [*SEG, "model_name"]), 3)


@query
def trainer_metrics(spark, base):
    return show(metrics.trainer_metrics(naive_predictions(spark, base), [*SEG, "model_name"]), 3)


@query
def fold_metrics(spark, base):
    folds = splits.walk_forward_split(naive_predictions(spark, base), [*SEG, "model_name"], 5)
    per = metrics.regression_metrics(folds.filter(F.col("role") == "test"), [*SEG, "model_name", "fold"])
    return show(metrics.fold_metrics(per, [*SEG, "model_name"]), 2)


@query
def rank_models(spark, base):
    m = metrics.trainer_metrics(naive_predictions(spark, base), [*SEG, "model_name"]).withColumnRenamed("mape", "test_mape")
    return show(metrics.rank_models(m, SEG), 3)


@query
def best_model(spark, base):
    m = metrics.trainer_metrics(naive_predictions(spark, base), [*SEG, "model_name"]).withColumnRenamed("mape", "test_mape")
    return show(metrics.best_model(m, SEG), 3)


@query
def target_check(spark, base):
    m = metrics.trainer_metrics(naive_predictions(spark, base), [*SEG, "model_name"]).withColumnRenamed("mape", "test_mape")
    out = metrics.target_check(m, SEG)
    return show(out.withColumn("target_met", F.col("target_met").cast("int")), 3)


# --- paging, top-k, latest -------------------------------------------------------------------


@query
def history_page(spark, base):
    return show(reshape.paginate(sales(spark, base).select(*SEG, "date", "daily_sales"), ["date", *SEG], 100, 50, "1996-01-01"))


@query
def last_rows_per_series(spark, base):
    return show(reshape.last_rows(sales(spark, base).select(*SEG, "date", "daily_sales"), SEG, 42))


@query
def latest_event_per_user(spark, base):
    e = table(spark, base, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return show(reshape.latest_per(e, ["user_id"], "ts", "event_id"))


# --- events ----------------------------------------------------------------------------------


@query
def sessionize(spark, base):
    return show(sessions.sessionize(table(spark, base, "events"), ["user_id"], value="value"), 2)


@query
def last_events_per_user(spark, base):
    e = table(spark, base, "events").select("event_id", "ts", "user_id", "event_type")
    return show(sessions.last_items(e, ["user_id"]))


@query
def user_liveness(spark, base):
    out = sessions.liveness(table(spark, base, "events"), ["user_id"])
    return show(out.withColumns({c: F.col(c).cast("int") for c in ("is_active", "is_stale")}), 6)


@query
def log_severity(spark, base):
    e = table(spark, base, "events")
    lines = e.select(F.to_date("ts").alias("date"), F.concat_ws(" ", "event_type", "props").alias("line"))
    return show(sessions.severity_counts(lines, "line", ["date"]))


@query
def document_severity(spark, base):
    return show(sessions.severity_counts(table(spark, base, "documents").select("source", "text"), "text", ["source"]))


# --- models and forecasts --------------------------------------------------------------------


def _linear(spark, base, include_dow: bool, n_days: int = 30) -> DataFrame:
    return linear.forecast(linear.fit(sales(spark, base), SEG, {"include_dow": include_dow}), n_days)


@query
def lag_feature_matrix(spark, base):
    return show(trees.lag_matrix(sales(spark, base), SEG).drop("n_train"))


@query
def robust_sigma(spark, base):
    n = naive_predictions(spark, base).withColumn("residual", F.col("actual") - F.col("predicted"))
    return show(base_model.robust_sigma(n, [*SEG, "model_name"]), 2)


@query
def future_calendar(spark, base):
    last = sales(spark, base).groupBy(*SEG).agg(F.max("date").alias("last_date"))
    return show(base_model.future_calendar(last, 365))


@query
def linear_trend_forecast(spark, base):
    return show(_linear(spark, base, False), 2)


@query
def linear_weekday_forecast(spark, base):
    return show(_linear(spark, base, True), 2)


@query
def linear_in_sample(spark, base):
    p = sales(spark, base)
    return show(linear.in_sample(p, linear.fit(p, SEG)), 2)


@query
def linear_search(spark, base):
    scores, candidates = search.score(sales(spark, base), SEG, linear.NAME, 10)
    return show(search.best_params(scores, SEG, candidates), 3)


def two_models(spark, base) -> DataFrame:
    plain = _linear(spark, base, False).withColumn("model", F.lit("plain"))
    return plain.unionByName(_linear(spark, base, True).withColumn("model", F.lit("weekday")))


@query
def ensemble_forecast(spark, base):
    return show(ensemble.ensemble(two_models(spark, base), SEG, {"plain": 3.0, "weekday": 1.0}), 2)


@query
def compare_forecasts(spark, base):
    return show(reshape.compare_forecasts(two_models(spark, base), SEG, ["plain", "weekday"], True), 2)


@query
def pivot_forecasts(spark, base):
    return show(reshape.pivot_forecasts(two_models(spark, base), SEG, ["plain", "weekday"]), 2)


@query
def forecast_summary(spark, base):
    return show(ensemble.forecast_summary(two_models(spark, base), [*SEG, "model"]), 2)


@query
def forecast_table(spark, base):
    return show(reshape.forecast_table(two_models(spark, base), SEG), 2)


@query
def forecast_export(spark, base):
    return sinks.forecast_export(_linear(spark, base, True))


@query
def history_and_forecast(spark, base):
    return show(reshape.stitch(sales(spark, base), _linear(spark, base, True), SEG, 60), 2)


@query
def decomposable_forecast(spark, base):
    return show(decomposable.forecast(decomposable.fit(sales(spark, base), SEG), 30), 2)


@query
def seasonal_arima_forecast(spark, base):
    return show(arima.forecast(arima.fit(sales(spark, base), SEG), 30), 2)


@query
def arima_closed_forms(spark, base):
    """Orders whose fit and forecast have a closed form: one autoregressive term, a drift, and last week's values."""
    orders = {
        "autoregression": {"p": 1, "d": 0, "q": 0, "trend": "c"},
        "drift": {"p": 0, "d": 1, "q": 0, "trend": "c"},
        "last_week": {"p": 0, "d": 0, "q": 0, "D": 1, "trend": "n"},
    }
    p = sales(spark, base)
    made = [arima.forecast(arima.fit(p, SEG, params), 30).withColumn("model", F.lit(name)) for name, params in orders.items()]
    return show(reduce(DataFrame.unionByName, made), 2)


@query
def boosted_trees_forecast(spark, base):
    fitted = trees.fit(sales(spark, base), SEG, trees.BOOSTED)
    return show(trees.forecast(fitted, 30), 2)


@query
def random_forest_forecast(spark, base):
    fitted = trees.fit(sales(spark, base), SEG, trees.FOREST)
    return show(trees.forecast(fitted, 30), 2)


@query
def forecast_contract(spark, base):
    """All five models at default size: what must hold for the forecasts of every series, whatever the fit."""
    fitted = registry.fit_models(sales(spark, base), SEG)
    ahead = forecasting.request_forecast(fitted, "all", 30)
    return show(ahead.groupBy(*SEG, "model").agg(
        F.count("*").alias("n_days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.count_distinct("day_number").alias("day_numbers"),
        F.count_if((F.col("lower_bound") <= F.col("predicted")) & (F.col("predicted") <= F.col("upper_bound"))).alias("n_bounded"),
        F.count_if((F.col("predicted") >= 0) & (F.col("lower_bound") >= 0)).alias("n_non_negative"),
    ))


@query
def forecast_after_newer_data(spark, base):
    """A model fitted without the last fifth of each series forecasts the days after the data, the gap counted."""
    p = sales(spark, base)
    train = splits.simple_split(p, SEG, 0.8).filter(F.col("role") == "train").drop("fold", "role")
    fitted = {linear.NAME: linear.fit(train, SEG, {"include_dow": False})}
    newest = p.groupBy(*SEG).agg(F.max("date").alias("last_date"))
    return show(forecasting.request_forecast(fitted, linear.NAME, 30, newest=newest).select(*SEG, "model", "date", "day_number", "predicted"), 2)


@query
def forest_learning_curve(spark, base):
    fitted = trees.fit(sales(spark, base), SEG, trees.FOREST, curve=True)
    return show(attach(fitted.curve, trees.curve_verdict(fitted.curve).select("verdict"), []), 2)


@query
def forest_importance(spark, base):
    fitted = trees.fit(sales(spark, base), SEG, trees.FOREST)
    return show(fitted.importances, 4)


@query
def decomposable_search(spark, base):
    scores, candidates = search.score(sales(spark, base), SEG, decomposable.NAME, 10)
    return show(search.best_params(scores, SEG, candidates), 3)


@query
def arima_search(spark, base):
    scores, candidates = search.score(sales(spark, base), SEG, arima.NAME, 10)
    return show(search.best_params(scores, SEG, candidates), 3)


@query
def ranked_backtest(spark, base):
    """All five models trained, tested on untouched rows, and ranked per series; a refit would not change the ranking.

    A model that cannot be trained fails the query: ranks among the others would pass for ranks among all.
    """
    _, ranked, _ = training.train_all(sales(spark, base), SEG, train_on_full_data=False, needs_all=True)
    return show(ranked.drop("run_id", "training_time"), 3)


@query
def actual_and_predicted(spark, base):
    """The last fifth of each series beside the forecast of a line through the rest, met by date."""
    split = splits.simple_split(sales(spark, base), SEG, 0.8)
    train, test = (split.filter(F.col("role") == r).drop("fold", "role") for r in ("train", "test"))
    ahead = linear.forecast(linear.fit(train, SEG, {"include_dow": False}), search.horizon(train, test, SEG), include_ci=False, limit=None)
    actual = test.select(*SEG, "date", F.col("daily_sales").alias("actual"))
    return show(metrics.align(actual, ahead, SEG).select(*SEG, "date", "actual", "predicted"), 2)


@query
def refitted_model_forecast(spark, base):
    """Training with the full refit: the model that is kept forecasts from all rows."""
    trained = training.train_model(sales(spark, base), SEG, linear.NAME, params={"include_dow": True, "regularization": 0.0})
    return show(linear.forecast(trained.fitted, 30), 2)


@query
def reloaded_model_forecast(spark, base):
    """A saved model, loaded again, forecasts as before."""
    path = new_path(spark, "model")
    linear.fit(sales(spark, base), SEG, {"include_dow": True}).save(path)
    return show(linear.forecast(base_model.Fitted.load(spark, path), 30), 2)


@query
def best_model_forecast(spark, base):
    """The best model of each series answers for it: here the line where the name has an even length, else ARIMA."""
    p = sales(spark, base)
    fitted = {linear.NAME: linear.fit(p, SEG, {"include_dow": True}), arima.NAME: arima.fit(p, SEG)}
    even = F.length("c_mktsegment") % 2 == 0
    best = p.select(*SEG).distinct().withColumn("model_name", F.when(even, linear.NAME).otherwise(arima.NAME))
    out = forecasting.request_forecast(fitted, "best", 30, best=best)
    return show(out.select(*SEG, "model", "date", "day_number", F.when(F.col("model") == linear.NAME, F.col("predicted")).alias("predicted")), 2)


@query
def ensemble_request(spark, base):
    """The ensemble as a model choice, over a horizon of a week, with its interval."""
    fitted = {linear.NAME: linear.fit(sales(spark, base), SEG, {"include_dow": True})}
    return show(forecasting.request_forecast(fitted, "ensemble", 30, weights={linear.NAME: 2.0}), 2)


@query
def upload_findings(spark, base):
    """All checks with their messages on a table with texts for date and measure, an extra column and three missing ones."""
    upload = table(spark, base, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_totalprice").cast("string").alias("daily_sales"),
        F.col("o_orderstatus").alias("product_category"), F.col("o_orderpriority").alias("priority"))
    return show(quality.validate(upload).select("check", "severity", "column", "count", "pct", "message"))


@query
def dispatched_sources(spark, base):
    """The panel written in four formats and read back by source kind and date bounds, and as a raw file."""
    out = new_path(spark, "sources")
    p = panel(spark, base)
    parts = []
    for kind in ("parquet", "orc", "json", "csv"):
        sinks.write_table(p, f"{out}/{kind}", kind)
        read = read_sales(spark, kind, f"{out}/{kind}", "1996-01-01", "1997-12-31")
        parts.append(read.select(F.lit(kind).alias("source"), F.col("date").cast("date").alias("date"), F.col("daily_sales").cast("double").alias("y")))
    raw = read_raw(spark, "csv", DEFAULT.with_(raw_dir=out))
    parts.append(raw.select(F.lit("raw").alias("source"), "date", F.col("daily_sales").alias("y")))
    return show(reduce(DataFrame.unionByName, parts).groupBy("source").agg(
        F.count("*").alias("n"), F.min("date").alias("start"), F.max("date").alias("end"), F.sum("y").alias("total")), 2)


@query
def forecast_file(spark, base):
    path = new_path(spark, "forecast-csv")
    sinks.write_forecasts_csv(_linear(spark, base, True), path)
    kinds = "c_mktsegment string, model string, date date, day_number int, predicted double, lower_bound double, upper_bound double"
    return show(spark.read.schema(kinds).option("header", True).csv(path), 2)


@query
def report_and_run_files(spark, base):
    """The JSON report and the JSON runs, read back: row counts, findings and stored scores."""
    path = new_path(spark, "report")
    raw = written(raw_sales(spark, base), "raw")
    clean = raw.dropna(subset=["date"])
    sinks.write_report(spark, path, raw.count(), clean.count(), quality.missing_values(raw, SEG), quality.missing_values(clean, SEG))
    sinks.write_runs_json(_runs(spark, base), f"{path}/runs")
    summary = spark.read.json(f"{path}/summary").select("pipeline_summary.*")
    facts = [summary.select(F.lit(c).alias("fact"), F.col(c).cast("double").alias("value")) for c in ("initial_rows", "final_rows", "rows_removed")]
    for part in ("validation", "features"):
        facts.append(spark.read.json(f"{path}/{part}").agg(F.sum("count").cast("double").alias("value")).select(F.lit(part).alias("fact"), "value"))
    facts.append(spark.read.json(f"{path}/runs").agg(F.sum("test_mape").alias("value")).select(F.lit("test_mape").alias("fact"), "value"))
    return show(reduce(DataFrame.unionByName, facts), 3)


@query
def features_and_target(spark, base):
    """The target by name, the features without date, target and categories, and what both hold."""
    made = features.create_features(panel(spark, base), SEG, "minimal")
    x, y = splits.feature_target_split(made, resolve_target(made))
    names = [c for c in x.columns if c not in SEG]
    told = x.agg(F.lit(",".join(sorted(names))).alias("names"), F.count("*").alias("n"), F.sum("marketing_spend").alias("spend"))
    return show(attach(told, y.agg(F.sum(y.columns[0]).alias("target")), []), 2)


@query
def stored_insights(spark, base):
    store = ResultsStore(spark, new_path(spark, "store"), SEG)
    p = sales(spark, base)
    store.save_insights("a1", p.groupBy(*SEG).agg(
        F.struct(F.count("*").alias("days"), F.date_format(F.min("date"), "yyyy-MM-dd").alias("first")).alias("span"),
        F.create_map(F.lit("holidays"), F.sum("is_holiday"), F.lit("gaps"), F.lit(None).cast("long")).alias("flags"),
        F.max("product_category").alias("category")))
    return show(store.insights("a1").select(*SEG, "insight_type", "insight_key", "insight_value"))


@query
def stored_learning_curve(spark, base):
    store = ResultsStore(spark, new_path(spark, "store"), [])
    months = sales(spark, base).groupBy(F.month("date").alias("iteration")).agg(
        F.avg("daily_sales").alias("train_loss"), F.stddev_samp("daily_sales").alias("val_loss"))
    store.save_learning_curve("r1", "boosted_trees", months)
    return show(store.learning_curve("r1").select("run_id", "model_name", "iteration", "train_loss", "val_loss", "metric_type"), 4)


# --- results store ---------------------------------------------------------------------------


def _runs(spark, base) -> DataFrame:
    m = metrics.trainer_metrics(naive_predictions(spark, base), [*SEG, "model_name"])
    named = m.select(*SEG, "model_name", *[F.col(c).alias(f"test_{c}") for c in ("mape", "mae", "rmse")])
    return named.withColumns({
        "run_id": F.concat_ws("-", *SEG, "model_name"),
        "best_params": F.to_json(F.struct(F.col("model_name").alias("name"))),
    })


def _store(spark, base) -> ResultsStore:
    """Every run is saved twice: first with a wrong score, then with the right one."""
    store = ResultsStore(spark, new_path(spark, "store"), SEG)
    runs = written(_runs(spark, base), "runs")
    store.save_runs(runs.withColumns({"test_mape": F.lit(0.0), "created_at": F.timestamp_seconds(F.lit(0))}))
    store.save_runs(runs)
    return store


@query
def stored_runs(spark, base):
    return show(_store(spark, base).runs().select(*SEG, "run_id", "model_name", "test_mape", "test_mae"), 3)


@query
def stored_best_model(spark, base):
    return show(_store(spark, base).best_model().select(*SEG, "model_name", "test_mape"), 3)


@query
def stored_metrics_table(spark, base):
    out = _store(spark, base).metrics().select(*SEG, "model_name", "test_mape", F.col("best_params")["name"].alias("param"), "target_met")
    return show(out.withColumn("target_met", F.col("target_met").cast("int")), 3)


@query
def models_with_latest_run(spark, base):
    return show(_store(spark, base).models(["naive_1", "naive_7", "absent"]).select(*SEG, "model_name", "test_mape"), 3)


@query
def stored_comparison(spark, base):
    store = ResultsStore(spark, new_path(spark, "store"), SEG)
    store.save_comparison("c1", _runs(spark, base))
    return show(store.comparisons("c1").select(*SEG, "comparison_id", "rank", "model_name", "test_mape"), 3)


@query
def stored_forecast_summary(spark, base):
    store = ResultsStore(spark, new_path(spark, "store"), SEG)
    store.save_forecasts("f1", two_models(spark, base))
    return show(store.forecast_summary("f1"), 2)


@query
def stored_forecast_comparison(spark, base):
    store = ResultsStore(spark, new_path(spark, "store"), SEG)
    store.save_forecasts("f1", two_models(spark, base))
    return show(store.forecast_comparison(["plain", "weekday"]), 2)


@query
def stored_importance(spark, base):
    """Absolute correlation with the target as the score: saved for two runs, the later one is read though its id sorts first."""
    cols = ["marketing_spend", "is_holiday", "day_of_week_num", "daily_sales_lag_1"]
    made = features.create_features(panel(spark, base), SEG, "minimal")
    scores = eda.target_correlations(made, [], cols).select(
        F.col("column").alias("feature_name"), F.col("correlation").alias("importance_score"))
    store = ResultsStore(spark, new_path(spark, "store"))
    store.save_importance("run-9", "random_forest", scores.select("feature_name", F.lit(0.0).alias("importance_score")))
    store.save_importance("run-1", "random_forest", scores)
    return show(store.latest_importance("random_forest").drop("created_at"), 7)


@query
def forecast_ids_newest_first(spark, base):
    e = table(spark, base, "events").select(F.col("user_id").alias("forecast_id"), F.col("ts").alias("created_at"))
    return show(e.groupBy("forecast_id").agg(F.max("created_at").alias("created_at")).orderBy(F.desc("created_at")))


@query
def flattened_insights(spark, base):
    p = sales(spark, base)
    wide = p.groupBy(*SEG).agg(
        F.struct(F.count("*").alias("days"), F.date_format(F.min("date"), "yyyy-MM-dd").alias("first")).alias("span"),
        F.create_map(F.lit("holidays"), F.sum("is_holiday"), F.lit("gaps"), F.lit(None).cast("long")).alias("flags"),
        F.max("product_category").alias("category"),
    )
    return show(reshape.flatten_insights(wide, SEG))


@query
def zipped_learning_curve(spark, base):
    season = eda.season_profile(sales(spark, base), SEG)
    m = season.filter(F.col("level") == "month").groupBy(*SEG).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("period", "mean"))), lambda r: r["mean"]).alias("train_losses"))
    runs = m.withColumn("val_losses", F.slice("train_losses", 1, 6))
    return show(reshape.zip_learning_curve(runs, SEG), 6)


@query
def stripped_parameter_names(spark, base):
    t = table(spark, base, "part")
    prefix = F.element_at(F.array(*[F.lit(p) for p in ("lt_", "xgb_", "rf_", "prophet_", "sarima_", "")]), F.col("p_size") % 6 + 1)
    return show(t.select("p_partkey", strip_param_prefix(F.concat(prefix, F.lower("p_brand"))).alias("param")))


@query
def import_and_reload(spark, base):
    path = new_path(spark, "raw_sales")
    sinks.import_sales(panel(spark, base), path, SEG)
    return show(load_sales(spark, path))


# --- streams ---------------------------------------------------------------------------------


def _event_stream(spark, base) -> DataFrame:
    return stream.read_events(spark, base, table(spark, base, "events").schema, "events.parquet")


@query
def streamed_sessions(spark, base):
    """Closed sessions only: the watermark trails the newest event by a day."""
    out, mark = new_path(spark, "sessions"), new_path(spark, "mark")
    stream.run_available(stream.session_stream(_event_stream(spark, base), ["user_id"]), out, mark)
    return show(spark.read.parquet(out), 2)


@query
def streamed_severity(spark, base):
    out, mark = new_path(spark, "severity"), new_path(spark, "mark")
    lines = _event_stream(spark, base).withColumn("line", F.concat_ws(" ", "event_type", "props"))
    stream.run_available(stream.severity_stream(lines, "line"), out, mark)
    return show(spark.read.parquet(out))


@query
def streamed_last_events(spark, base):
    out, mark = new_path(spark, "last"), new_path(spark, "mark")
    stream.keep_last_items(_event_stream(spark, base).select("event_id", "ts", "user_id"), ["user_id"], out, mark)
    return show(stream.read_last_items(spark, out, ["user_id"]))


@query
def streamed_silences(spark, base):
    """Users that fall silent for five minutes, and for an hour, each silence once, as the watermark passes."""
    out, mark = new_path(spark, "silent"), new_path(spark, "mark")
    stream.run_available(state.silent_entities(_event_stream(spark, base), ["user_id"]), out, mark)
    return show(spark.read.parquet(out))


@query
def csv_intake(spark, base):
    """The panel goes out as CSV and comes back through the validating stream."""
    folder, out = new_path(spark, "csv"), new_path(spark, "intake")
    p = panel(spark, base)
    sinks.write_csv(p, folder)
    raw = intake.stream_csv(spark, folder, p.columns)
    intake.intake(raw, f"{out}/good", f"{out}/bad", f"{out}/checks", f"{out}/mark", SEG)
    return show(intake.loaded(spark, f"{out}/good", SEG))
