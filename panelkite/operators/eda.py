"""Exploratory statistics per series.

All functions take a daily panel (one row per series and day), so a series is bounded by the
calendar and window frames over a whole series are safe. A window over the keys and the aggregate
after it share one exchange: each function reads its input once.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelkite.config import DEFAULT, PanelConfig, numeric_columns
from panelkite.functions import calendar as cal
from panelkite.functions import windows as win
from panelkite.functions.keys import series_window, whole_series
from panelkite.functions.scalars import inverse_normal, t_two_sided_p
from panelkite.operators.gram import wide_correlations

AUTOCORR_LAGS = (1, 7, 14, 30)
WIDE_COLUMNS = 20


def bias_corrected_skew(g1: Column, n: Column) -> Column:
    """Sample skewness G1 from the population figure; NULL below three values, 0 without spread."""
    n = n.cast("double")
    g1 = F.when(~F.isnan(g1), g1).otherwise(F.lit(0.0))
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def bias_corrected_kurtosis(g2: Column, n: Column) -> Column:
    """Sample excess kurtosis G2 from the population figure; NULL below four values."""
    n = n.cast("double")
    flat = F.isnan(g2) | g2.isNull()
    value = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return F.when(n > 3, F.when(flat, F.lit(0.0)).otherwise(value))


def _positioned(df: DataFrame, keys: list[str], cfg: PanelConfig) -> DataFrame:
    w, whole = series_window(keys, cfg.date_col), whole_series(keys, cfg.date_col)
    return df.select("*", win.position(w).alias("__pos"), F.count(F.lit(1)).over(whole).alias("__n"))


def _basic_aggs(x: str, cfg: PanelConfig) -> list[Column]:
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    n = F.count(x)
    return [
        F.count(F.lit(1)).alias("count"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        q[1].alias("median"),
        q[0].alias("q1"),
        q[2].alias("q3"),
        (q[2] - q[0]).alias("iqr"),
        bias_corrected_skew(F.skewness(x), n).alias("skewness"),
        bias_corrected_kurtosis(F.kurtosis(x), n).alias("kurtosis"),
        (F.try_divide(F.stddev_samp(x), F.avg(x)) * 100).alias("cv"),
        F.min(cfg.date_col).alias("date_start"),
        F.max(cfg.date_col).alias("date_end"),
        (F.datediff(F.max(cfg.date_col), F.min(cfg.date_col)) + 1).cast("long").alias("date_range_days"),
    ]


def basic_stats(df: DataFrame, keys: list[str], cfg: PanelConfig = DEFAULT) -> DataFrame:
    return df.groupBy(*keys).agg(*_basic_aggs(cfg.target_col, cfg))


def table_summary(df: DataFrame, cfg: PanelConfig = DEFAULT) -> DataFrame:
    """Record count, date span, mean and range of the target over the whole table."""
    y = cfg.target_col
    return df.agg(
        F.count("*").alias("total_records"),
        F.min(cfg.date_col).alias("start_date"),
        F.max(cfg.date_col).alias("end_date"),
        F.avg(y).alias("avg_sales"),
        F.min(y).alias("min_sales"),
        F.max(y).alias("max_sales"),
    )


def history_summary(df: DataFrame, keys: list[str], cfg: PanelConfig = DEFAULT) -> DataFrame:
    y = cfg.target_col
    return df.groupBy(*keys).agg(
        F.count("*").alias("count"),
        F.round(F.avg(y), 2).alias("mean"),
        F.round(F.min(y), 2).alias("min"),
        F.round(F.max(y), 2).alias("max"),
        F.round(F.stddev_samp(y), 2).alias("std"),
    )


def _trend_aggs(y: str) -> list[Column]:
    x, v, half = F.col("__pos"), F.col(y), F.floor(F.col("__n") / 2)
    first, second = F.avg(F.when(x < half, v)), F.avg(F.when(x >= half, v))
    slope = F.regr_slope(v, x)
    return [
        slope.alias("slope"),
        F.regr_intercept(v, x).alias("intercept"),
        F.regr_r2(v, x).alias("r_squared"),
        F.count(v).alias("n"),
        F.when(slope > 0, "upward").otherwise("downward").alias("trend_direction"),
        first.alias("first_half_avg"),
        second.alias("second_half_avg"),
        (F.try_divide(second - first, first) * 100).alias("growth_rate_percent"),
    ]


def trend(df: DataFrame, keys: list[str], cfg: PanelConfig = DEFAULT, p_value: bool = True) -> DataFrame:
    """Least-squares line over the position, its fit, and half-over-half growth."""
    out = _positioned(df, keys, cfg).groupBy(*keys).agg(*_trend_aggs(cfg.target_col))
    if not p_value:
        return out
    nu = F.col("n") - 2
    t = F.sqrt(F.try_divide(F.col("r_squared") * nu, 1 - F.col("r_squared")))
    exact = (F.col("r_squared") >= 1.0) & (nu > 0)
    p = t_two_sided_p(t.cast("double"), nu.cast("double"))
    return out.withColumn("p_value", F.when(exact, F.lit(0.0)).otherwise(p))


def trend_residuals(df: DataFrame, keys: list[str], cfg: PanelConfig = DEFAULT) -> DataFrame:
    """Rows with their trend value and residual. The line is fitted by windows over the same partition."""
    whole, y = whole_series(keys, cfg.date_col), F.col(cfg.target_col)
    x = F.col("__pos")
    placed = _positioned(df, keys, cfg)
    fitted = placed.select(
        "*",
        F.regr_slope(y, x).over(whole).alias("__slope"),
        F.regr_intercept(y, x).over(whole).alias("__icpt"),
    )
    line = F.col("__slope") * x + F.col("__icpt")
    return fitted.select(*df.columns, line.alias("trend"), (y - line).alias("residual"))


def monthly_averages(df: DataFrame, keys: list[str], cfg: PanelConfig = DEFAULT) -> DataFrame:
    return df.groupBy(*keys, cal.month_key(F.col(cfg.date_col)).alias("month")).agg(
        F.avg(cfg.target_col).alias("mean")
    )


def _weekday_means(y: str, d: Column) -> list[Column]:
    return [F.coalesce(F.avg(F.when(F.weekday(d) == i, F.col(y))), F.lit(0.0)) for i in range(7)]


def _weekday_summary(means: Column) -> dict[str, Column]:
    """Best and worst are the first in Monday-first order on ties."""
    names = F.array(*[F.lit(n) for n in cal.WEEKDAYS])
    at = lambda v: F.element_at(names, F.array_position(means, v).cast("int"))
    weekdays = sum((means[i] for i in range(1, 5)), means[0])
    return {
        "best_day": at(F.array_max(means)),
        "worst_day": at(F.array_min(means)),
        "weekend_avg": (means[5] + means[6]) / 2,
        "weekday_avg": weekdays / 5,
    }


def weekday_profile(df: DataFrame, keys: list[str], cfg: PanelConfig = DEFAULT) -> DataFrame:
    """Seven rows per series, 0 for a weekday that never occurs."""
    means = F.array(*_weekday_means(cfg.target_col, F.col(cfg.date_col)))
    rows = df.groupBy(*keys).agg(means.alias("m"))
    out = rows.select(*keys, F.posexplode("m").alias("dow", "mean"))
    names = F.array(*[F.lit(n) for n in cal.WEEKDAYS])
    return out.select(*keys, "dow", F.element_at(names, F.col("dow") + 1).alias("weekday"), "mean")


def weekday_summary(df: DataFrame, keys: list[str], cfg: PanelConfig = DEFAULT) -> DataFrame:
    means = F.array(*_weekday_means(cfg.target_col, F.col(cfg.date_col)))
    out = df.groupBy(*keys).agg(means.alias("m"))
    return out.select(*keys, *[c.alias(n) for n, c in _weekday_summary(F.col("m")).items()])


def season_profile(df: DataFrame, keys: list[str], cfg: PanelConfig = DEFAULT) -> DataFrame:
    """``keys, level, period, mean, is_best, is_worst`` for months and quarters in one pass."""
    d, y = F.col(cfg.date_col), cfg.target_col
    base = df.select(*keys, F.month(d).alias("__m"), F.quarter(d).alias("__q"), y)
    sums = base.groupBy(*keys, "__m", "__q").agg(F.sum(y).alias("s"), F.count(y).alias("c"))
    levels = F.array(
        F.struct(F.lit("month").alias("level"), F.col("__m").alias("period")),
        F.struct(F.lit("quarter").alias("level"), F.col("__q").alias("period")),
    )
    # At most twelve rows per series reach the second aggregate.
    per = (
        sums.select(*keys, F.explode(levels).alias("l"), "s", "c")
        .groupBy(*keys, "l.level", "l.period")
        .agg(F.try_divide(F.sum("s"), F.sum("c")).alias("mean"))
    )

    group = W.partitionBy(*keys, "level")
    best = F.max(F.struct("mean", -F.col("period"))).over(group)
    worst = F.min(F.struct("mean", "period")).over(group)
    return per.select(
        *keys, "level", "period", "mean",
        (-best["col2"] == F.col("period")).alias("is_best"),
        (worst["period"] == F.col("period")).alias("is_worst"),
    )


def _holiday_aggs(y: str, flag: str) -> list[Column]:
    on, off = (F.avg(F.when(F.col(flag) == v, F.col(y))) for v in (1, 0))
    lift = F.when(off > 0, (on - off) / off * 100).otherwise(F.lit(0.0))
    return [on.alias("holiday_avg"), off.alias("non_holiday_avg"), lift.alias("holiday_lift_percent")]


def holiday_effect(df: DataFrame, keys: list[str], cfg: PanelConfig = DEFAULT) -> DataFrame:
    return df.groupBy(*keys).agg(*_holiday_aggs(cfg.target_col, cfg.holiday_col))


def _corr(a: Column, b: Column) -> Column:
    """Pearson correlation over complete pairs, NULL when a side has no spread (``corr`` would raise)."""
    spread = F.sqrt(F.regr_sxx(a, b)) * F.sqrt(F.regr_syy(a, b))
    return F.try_divide(F.regr_sxy(a, b), spread)


def autocorrelation(
    df: DataFrame, keys: list[str], lags: tuple[int, ...] = AUTOCORR_LAGS, cfg: PanelConfig = DEFAULT
) -> DataFrame:
    """``keys, lag_k`` for every k: Pearson of the series with itself shifted, pairwise complete."""
    y, w = F.col(cfg.target_col), series_window(keys, cfg.date_col)
    shifted = df.select(*keys, y.alias("__y"), *[F.lag(y, k).over(w).alias(f"__l{k}") for k in lags])
    return shifted.groupBy(*keys).agg(*_autocorr_aggs(lags))


def _autocorr_aggs(lags: tuple[int, ...]) -> list[Column]:
    return [
        F.when(F.count(F.lit(1)) > k, _corr(F.col("__y"), F.col(f"__l{k}"))).alias(f"lag_{k}") for k in lags
    ]


def acf(df: DataFrame, keys: list[str], max_lag: int = 60, cfg: PanelConfig = DEFAULT) -> DataFrame:
    """Biased autocorrelation up to ``max_lag`` with 95 % and 99 % white-noise bands."""
    y, w, whole = F.col(cfg.target_col), series_window(keys, cfg.date_col), whole_series(keys, cfg.date_col)
    centred = df.select(*keys, cfg.date_col, (y - F.avg(y).over(whole)).alias("__c"))
    c = F.col("__c")
    led = centred.select(*keys, "__c", *[F.lead("__c", h).over(w).alias(f"__h{h}") for h in range(1, max_lag + 1)])
    sums = led.groupBy(*keys).agg(
        F.count("__c").alias("n"),
        F.sum(c * c).alias("c0"),
        F.array(F.sum(c * c), *[F.coalesce(F.sum(c * F.col(f"__h{h}")), F.lit(0.0)) for h in range(1, max_lag + 1)]).alias("s"),
    )
    out = sums.select(*keys, "n", "c0", F.posexplode("s").alias("lag", "s")).filter(F.col("lag") < F.col("n"))
    root = F.sqrt(F.col("n").cast("double"))
    return out.select(
        *keys, "lag", F.try_divide(F.col("s"), F.col("c0")).alias("acf"),
        (F.lit(1.96) / root).alias("band_95"), (F.lit(2.576) / root).alias("band_99"),
    )


def target_correlations(
    df: DataFrame, keys: list[str], columns: list[str] | None = None, cfg: PanelConfig = DEFAULT
) -> DataFrame:
    """``keys, column, correlation, rank``: strongest first, undefined ones left out."""

    y = cfg.target_col
    columns = columns or numeric_columns(df, exclude=[*keys, y])
    if not columns:
        empty = df.groupBy(*keys).agg(F.lit("").alias("column"), F.lit(0.0).alias("correlation"), F.lit(0).alias("rank"))
        return empty.filter(F.lit(False))
    wide = df.groupBy(*keys).agg(*[_corr(F.col(y), F.col(c)).alias(c) for c in columns])
    long = wide.unpivot(keys, columns, "column", "correlation").filter(F.col("correlation").isNotNull())
    order = W.partitionBy(*keys).orderBy(F.desc(F.abs("correlation")), "column")
    return long.withColumn("rank", F.row_number().over(order))


def correlation_matrix(
    df: DataFrame, keys: list[str], columns: list[str] | None = None, cfg: PanelConfig = DEFAULT
) -> DataFrame:
    """``keys, column_a, column_b, correlation`` for the lower triangle, pairwise complete, one pass.

    One aggregate per pair for a few columns; from ``WIDE_COLUMNS`` on blocked products, whose plan does not grow with the pairs.
    """
    columns = columns or numeric_columns(df, exclude=keys)
    if len(columns) >= WIDE_COLUMNS:
        return wide_correlations(df, keys, columns)
    pairs = list(combinations(columns, 2))
    cells = [
        F.struct(F.lit(b).alias("column_a"), F.lit(a).alias("column_b"), _corr(F.col(a), F.col(b)).alias("correlation"))
        for a, b in pairs
    ]
    wide = df.groupBy(*keys).agg(*[c.alias(f"c{i}") for i, c in enumerate(cells)])
    return wide.select(*keys, F.inline(F.array(*[F.col(f"c{i}") for i in range(len(cells))])))


def _with_quartiles(df: DataFrame, by: list[str], cfg: PanelConfig) -> DataFrame:
    whole = whole_series(by, cfg.date_col)
    probs = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    out = df.withColumn("__q", F.percentile(cfg.target_col, probs).over(whole))
    iqr = F.col("__q")[2] - F.col("__q")[0]
    return out.select(
        "*", (F.col("__q")[0] - 1.5 * iqr).alias("__lo"), (F.col("__q")[2] + 1.5 * iqr).alias("__hi")
    )


def outliers(df: DataFrame, keys: list[str], cfg: PanelConfig = DEFAULT) -> DataFrame:
    """IQR bounds and counts, and the count of values over three population deviations."""
    y, whole = F.col(cfg.target_col), whole_series(keys, cfg.date_col)
    rows = _with_quartiles(df, keys, cfg).withColumn(
        "__z", F.abs(F.try_divide(y - F.avg(y).over(whole), F.stddev_pop(y).over(whole)))
    )
    return rows.groupBy(*keys).agg(*_outlier_aggs(y))


def _outlier_aggs(y: Column) -> list[Column]:
    n = F.count(F.lit(1))
    beyond = F.count_if((y < F.col("__lo")) | (y > F.col("__hi")))
    far = F.count_if(F.col("__z") > 3)
    return [
        F.max("__lo").alias("lower_bound"),
        F.max("__hi").alias("upper_bound"),
        beyond.alias("iqr_outliers"),
        (100.0 * beyond / n).alias("iqr_outlier_percent"),
        far.alias("zscore_outliers"),
        (100.0 * far / n).alias("zscore_outlier_percent"),
    ]


def histogram(
    df: DataFrame, keys: list[str], bins: int = 30, column: str | None = None, cfg: PanelConfig = DEFAULT
) -> DataFrame:
    """Equal-width bins per series, empty ones included, with the mean and median as markers."""
    x, whole = F.col(column or cfg.target_col), whole_series(keys, cfg.date_col)
    base = df.filter(x.isNotNull()).select(
        *keys, x.alias("__x"), F.min(x).over(whole).alias("lo"), F.max(x).over(whole).alias("hi")
    )
    width = (F.col("hi") - F.col("lo")) / bins
    raw = F.floor(F.try_divide(F.col("__x") - F.col("lo"), width)) + 1
    binned = base.withColumn("bin", F.least(F.coalesce(raw, F.lit(1)), F.lit(bins)).cast("int"))
    counts = F.array(*[F.count_if(F.col("bin") == i) for i in range(1, bins + 1)])
    per = binned.groupBy(*keys).agg(
        F.first("lo").alias("lo"),
        F.first("hi").alias("hi"),
        F.avg("__x").alias("mean"),
        F.percentile("__x", F.lit(0.5)).alias("median"),
        counts.alias("c"),
    )
    rows = per.select("*", F.posexplode("c").alias("i", "count"))
    return rows.select(
        *keys,
        (F.col("i") + 1).alias("bin"),
        (F.col("lo") + F.col("i") * width).alias("bin_start"),
        (F.col("lo") + (F.col("i") + 1) * width).alias("bin_end"),
        "count", "mean", "median",
    )


def box_groups(df: DataFrame, cfg: PanelConfig = DEFAULT) -> DataFrame:
    """Each row once per grouping: all, weekday, quarter and (if present) holiday flag."""
    d = F.col(cfg.date_col)
    groups = [("all", F.lit("all")), ("weekday", cal.day_name(d)), ("quarter", F.quarter(d).cast("string"))]
    if cfg.holiday_col in df.columns:
        groups.append(("holiday", F.col(cfg.holiday_col).cast("string")))
    tags = F.array(*[F.struct(F.lit(g).alias("grouping"), v.alias("group")) for g, v in groups])
    return df.select("*", F.inline(tags))


def boxplot_stats(df: DataFrame, keys: list[str], cfg: PanelConfig = DEFAULT) -> DataFrame:
    """Quartiles, whiskers (extreme data inside the fences) and the number of fliers per group."""
    y, by = F.col(cfg.target_col), [*keys, "grouping", "group"]
    rows = _with_quartiles(box_groups(df, cfg), by, cfg)
    inside = y.between(F.col("__lo"), F.col("__hi"))
    return rows.groupBy(*by).agg(
        F.max(F.col("__q")[0]).alias("q1"),
        F.max(F.col("__q")[1]).alias("median"),
        F.max(F.col("__q")[2]).alias("q3"),
        F.min(F.when(inside, y)).alias("whisker_low"),
        F.max(F.when(inside, y)).alias("whisker_high"),
        F.count_if(~inside).alias("fliers"),
    )


def boxplot_fliers(df: DataFrame, keys: list[str], cfg: PanelConfig = DEFAULT) -> DataFrame:
    y, by = F.col(cfg.target_col), [*keys, "grouping", "group"]
    rows = _with_quartiles(box_groups(df, cfg), by, cfg)
    return rows.filter(~y.between(F.col("__lo"), F.col("__hi"))).select(*by, cfg.date_col, cfg.target_col)


def qq_points(df: DataFrame, keys: list[str], cfg: PanelConfig = DEFAULT) -> DataFrame:
    """Normal quantiles of the order-statistic medians against the sorted values, with the fitted line."""

    y = F.col(cfg.target_col)
    group = W.partitionBy(*keys)
    ranked = df.filter(y.isNotNull()).select(
        *keys,
        y.alias("ordered"),
        F.row_number().over(group.orderBy(cfg.target_col, cfg.date_col)).alias("i"),
        F.count(F.lit(1)).over(group).alias("n"),
    )
    n, i = F.col("n").cast("double"), F.col("i")
    last = F.pow(F.lit(0.5), 1 / n)
    # Fixed values 0.3175 and 0.365: the usual approximation of the order-statistic medians.
    m = F.when(i == n, last).when(i == 1, 1 - last).otherwise((i - 0.3175) / (n + 0.365))
    points = ranked.select(*keys, "i", "ordered", inverse_normal(m).alias("theoretical"))
    return points.select(
        *keys, "i", "theoretical", "ordered",
        F.regr_slope("ordered", "theoretical").over(group).alias("line_slope"),
        F.regr_intercept("ordered", "theoretical").over(group).alias("line_intercept"),
    )


def moving_averages(
    df: DataFrame, keys: list[str], windows: tuple[int, ...] = (7, 30), cfg: PanelConfig = DEFAULT
) -> DataFrame:
    w = series_window(keys, cfg.date_col)
    y = F.col(cfg.target_col)
    return df.select("*", *[win.moving_average(y, n, w).alias(f"ma_{n}") for n in windows])


def series_profile(df: DataFrame, keys: list[str], cfg: PanelConfig = DEFAULT) -> DataFrame:
    """One row per series with every statistic of the analysis bundle, from one exchange.

    Windows add the row facts (position, lags, quartiles, gaps); one aggregate over the same
    partitioning folds them. Reports and insights are projections of this frame.
    """
    y, d = F.col(cfg.target_col), F.col(cfg.date_col)
    w, whole = series_window(keys, cfg.date_col), whole_series(keys, cfg.date_col)
    rows = _with_quartiles(_positioned(df, keys, cfg), keys, cfg).select(
        "*",
        y.alias("__y"),
        F.abs(F.try_divide(y - F.avg(y).over(whole), F.stddev_pop(y).over(whole))).alias("__z"),
        win.gap_days(cfg.date_col, w).alias("__gap"),
        *[F.lag(y, k).over(w).alias(f"__l{k}") for k in AUTOCORR_LAGS],
    )
    others = numeric_columns(df, exclude=[*keys, cfg.target_col])
    aggs = _basic_aggs(cfg.target_col, cfg) + _trend_aggs(cfg.target_col) + _autocorr_aggs(AUTOCORR_LAGS)
    aggs += _outlier_aggs(y)
    aggs.append(F.array(*_weekday_means(cfg.target_col, d)).alias("weekday_means"))
    if cfg.holiday_col in df.columns:
        aggs += _holiday_aggs(cfg.target_col, cfg.holiday_col)
    pairs = [F.struct(F.lit(c).alias("column"), _corr(y, F.col(c)).alias("correlation")) for c in others]
    empty = F.array().cast("array<struct<column:string,correlation:double>>")
    aggs.append((F.array(*pairs) if pairs else empty).alias("correlations"))
    nullable = [c for c in df.columns if c not in keys]
    aggs.append(sum(((F.count(c) < F.count(F.lit(1))).cast("int") for c in nullable), F.lit(0)).alias("columns_with_nulls"))
    aggs.append(F.count_if(F.col("__gap") > 1).alias("date_gaps"))
    out = rows.groupBy(*keys).agg(*aggs)
    known = F.filter("correlations", lambda c: c.correlation.isNotNull())
    ordered = F.array_sort(
        known,
        lambda a, b: F.when(F.abs(a.correlation) > F.abs(b.correlation), -1)
        .when(F.abs(a.correlation) < F.abs(b.correlation), 1)
        .when(a.column < b.column, -1)
        .otherwise(1),
    )
    summary = _weekday_summary(F.col("weekday_means"))
    return out.withColumns({"correlations": ordered, **summary})
