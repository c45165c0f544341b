"""Features and statistics against pandas, per series and for one series."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Observation, Window
from pyspark.sql import functions as F

from panelkite.config import PanelConfig
from panelkite.functions import longseries
from panelkite.functions import windows as win
from panelkite.functions.scalars import incomplete_beta
from panelkite.functions.windows import with_ewm
from panelkite.operators import eda, features, report

from conftest import rows_of, sales_frame, to_spark

K = ["series_id"]


def close(a, b, **kw):
    return np.allclose(np.asarray(a, float), np.asarray(b, float), equal_nan=True, rtol=1e-9, atol=1e-9, **kw)


def test_minimal_set(one):
    out = features.create_features(one)
    names = features.feature_names(one, out)
    assert len(names) == 15
    got = rows_of(out, "date")
    assert got["daily_sales_lag_1"][1] == got["daily_sales"][0]
    assert got["day_of_week_sin"].between(-1, 1).all() and got["day_of_week_cos"].between(-1, 1).all()
    nulls = {r["feature"]: r["nulls"] for r in features.feature_summary(out, names).collect()}
    assert {k: v for k, v in nulls.items() if v} == {
        "daily_sales_lag_1": 1, "daily_sales_lag_7": 7, "daily_sales_diff_1": 1, "daily_sales_rolling_mean_7": 1,
        "daily_sales_rolling_std_7": 2, "marketing_spend_rolling_mean_7": 1}
    seen = Observation()
    assert features.drop_null_rows(out, seen=seen).count() == 93 and seen.get["dropped"] == 7


def test_full_set_matches_pandas(panel, panel_pdf):
    out = features.create_features(panel, K, "full")
    assert len(features.feature_names(panel, out)) == 68
    got = rows_of(out, "series_id", "date")
    want = []
    for _, g in panel_pdf.groupby("series_id"):
        g = g.sort_values("date").copy()
        y, d = g["daily_sales"], pd.to_datetime(g["date"])
        for n in (7, 14, 28):
            r = y.shift(1).rolling(n, min_periods=1)
            for s in ("mean", "std", "min", "max", "median", "sum"):
                g[f"daily_sales_rolling_{s}_{n}"] = getattr(r, s)()
            g[f"daily_sales_ewm_{n}"] = y.shift(1).ewm(span=n, min_periods=1).mean()
        for k in (1, 7):
            g[f"daily_sales_diff_{k}"], g[f"daily_sales_pct_change_{k}"] = y.diff(k), y.pct_change(k)
        for k in (1, 7, 14, 28):
            g[f"marketing_spend_lag_{k}"] = g["marketing_spend"].shift(k)
        g["week_of_year"] = d.dt.isocalendar().week.astype(int)
        for f in ("month_start", "month_end", "quarter_start", "quarter_end", "year_start", "year_end"):
            g[f"is_{f}"] = getattr(d.dt, f"is_{f}").astype(int)
        g["days_in_month"] = d.dt.days_in_month
        g["sales_vs_last_month"] = y / y.shift(28)
        g["marketing_efficiency_lag_7"] = (y / g["marketing_spend"]).shift(7)
        g["sales_deviation_28"] = y - g["daily_sales_rolling_mean_28"]
        g["time_normalized"] = (d - d.min()).dt.days / (d - d.min()).dt.days.max()
        want.append(g)
    want = pd.concat(want)
    for c in set(want.columns) - set(panel_pdf.columns):
        assert close(got[c], want[c]), c


def test_ewm_with_nulls_and_long_series(spark):
    rng = np.random.default_rng(1)
    n = 2500
    x = rng.normal(100, 30, n)
    x[rng.random(n) < 0.1] = np.nan
    pdf = pd.DataFrame({"i": range(n), "x": x})
    df = spark.createDataFrame(pdf).withColumn("date", F.date_add(F.lit("2000-01-01").cast("date"), F.col("i").cast("int")))
    df = df.withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    got = rows_of(with_ewm(df, [], "date", "x", (1, 2, 7, 28, 90), "e"), "i")
    for s in (1, 2, 7, 28, 90):
        want = pd.Series(x).shift(1).ewm(span=s, min_periods=1).mean()
        assert np.allclose(got[f"e{s}"], want, equal_nan=True, rtol=1e-10), s


def test_zero_denominators_give_null(spark):
    pdf = sales_frame(20)
    pdf.loc[5, "daily_sales"] = 0.0
    pdf.loc[9, "marketing_spend"] = 0.0
    got = rows_of(features.create_features(to_spark(spark, pdf), mode="full"), "date")
    assert math.isnan(got["daily_sales_pct_change_1"][6]) and math.isnan(got["marketing_efficiency"][9])


def test_optional_columns_and_config(one):
    cfg = PanelConfig(lag_days=(1,), rolling_windows=(7,))
    out = features.create_features(one.drop("marketing_spend", "is_holiday"), mode="full", cfg=cfg)
    assert not [c for c in out.columns if "marketing" in c or c == "holiday_weekend"]
    assert "sales_deviation_28" not in out.columns and "daily_sales_lag_7" not in out.columns


def test_partitioning_changes_nothing(panel):
    a = rows_of(features.create_features(panel, K), "series_id", "date")
    b = rows_of(features.create_features(panel.repartition(7, "date"), K), "series_id", "date")
    pd.testing.assert_frame_equal(a, b)


def test_basic_stats_and_trend(panel, panel_pdf):
    got = rows_of(eda.basic_stats(panel, K), "series_id")
    tr = rows_of(eda.trend(panel, K), "series_id")
    for i, (_, g) in enumerate(panel_pdf.groupby("series_id")):
        y = g.sort_values("date")["daily_sales"].to_numpy()
        s = pd.Series(y)
        for c, v in {"mean": s.mean(), "std": s.std(), "median": s.median(), "skewness": s.skew(), "kurtosis": s.kurtosis(),
                     "q1": s.quantile(.25), "cv": s.std() / s.mean() * 100}.items():
            assert got[c][i] == pytest.approx(v), c
        slope, icpt = np.polyfit(np.arange(len(y)), y, 1)
        r2 = np.corrcoef(np.arange(len(y)), y)[0, 1] ** 2
        assert (tr["slope"][i], tr["intercept"][i], tr["r_squared"][i]) == pytest.approx((slope, icpt, r2))
        half = len(y) // 2
        assert tr["growth_rate_percent"][i] == pytest.approx((y[half:].mean() - y[:half].mean()) / y[:half].mean() * 100)
        t = math.sqrt(r2 * (len(y) - 2) / (1 - r2))
        grid = np.linspace(t, 400, 2_000_001)
        nu = len(y) - 2
        const = math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(nu * math.pi)
        p = 2 * np.trapezoid(const * (1 + grid ** 2 / nu) ** (-(nu + 1) / 2), grid)
        assert tr["p_value"][i] == pytest.approx(p, rel=1e-6)


def test_incomplete_beta_known_values():
    assert incomplete_beta(np.array([1.0]), 1.0, np.array([0.3]))[0] == pytest.approx(0.3)
    assert incomplete_beta(np.array([2.0]), 0.5, np.array([0.8]))[0] == pytest.approx(1 - math.sqrt(0.2) * 1.4, rel=1e-9)
    assert incomplete_beta(np.array([5.0]), 0.5, np.array([0.0, 1.0])).tolist() == [0.0, 1.0]


def test_autocorrelation_and_correlations(panel, panel_pdf):
    got = rows_of(eda.autocorrelation(panel, K), "series_id")
    cor = rows_of(eda.target_correlations(panel, K), "series_id", "column")
    for i, (k, g) in enumerate(panel_pdf.groupby("series_id")):
        y = g.sort_values("date")["daily_sales"].reset_index(drop=True)
        for lag in (1, 7, 14, 30):
            assert got[f"lag_{lag}"][i] == pytest.approx(y.autocorr(lag))
        mine = cor[(cor["series_id"] == k) & (cor["column"] == "marketing_spend")]["correlation"].iloc[0]
        assert mine == pytest.approx(g["daily_sales"].corr(g["marketing_spend"]))


def test_constant_series_has_null_correlations(spark):
    pdf = sales_frame(40).assign(daily_sales=5.0)
    df = to_spark(spark, pdf)
    assert eda.autocorrelation(df, []).first()["lag_1"] is None
    assert eda.target_correlations(df, []).count() == 0
    out = eda.outliers(df, []).first()
    assert (out["iqr_outliers"], out["zscore_outliers"]) == (0, 0)
    assert [r["count"] for r in eda.histogram(df, [], 3).orderBy("bin").collect()] == [40, 0, 0]
    report.insights(report.analysis(df, []), []).collect()


def test_acf(one):
    y = rows_of(one, "date")["daily_sales"].to_numpy()
    c = y - y.mean()
    got = rows_of(eda.acf(one, [], 10), "lag")
    assert got["acf"].tolist() == pytest.approx([float((c[:len(c) - h] * c[h:]).sum() / (c * c).sum()) for h in range(11)])
    assert got["band_95"][0] == pytest.approx(0.196)


def test_weekday_profile_with_absent_day(spark):
    pdf = sales_frame(6, start="2023-01-02")  # Monday to Saturday
    got = rows_of(eda.weekday_profile(to_spark(spark, pdf), []), "dow")
    assert len(got) == 7 and got["mean"][6] == 0
    s = eda.weekday_summary(to_spark(spark, pdf), []).first()
    assert s["worst_day"] == "Sunday" and s["weekend_avg"] == pytest.approx(pdf["daily_sales"][5] / 2)


def test_histogram_and_boxplot(one):
    y = rows_of(one, "date")["daily_sales"]
    got = rows_of(eda.histogram(one, [], 25), "bin")
    assert got["count"].tolist() == np.histogram(y, 25)[0].tolist()
    box = eda.boxplot_stats(one, []).filter("grouping = 'all'").first()
    assert (box["q1"], box["median"], box["q3"]) == pytest.approx(tuple(y.quantile([.25, .5, .75])))


def test_qq_points(one):
    got = rows_of(eda.qq_points(one, []), "i")
    n = len(got)
    m = (np.arange(1, n + 1) - 0.3175) / (n + 0.365)
    m[-1], m[0] = 0.5 ** (1 / n), 1 - 0.5 ** (1 / n)
    assert got["theoretical"].tolist() == pytest.approx([NormalDist().inv_cdf(v) for v in m])
    assert got["ordered"].is_monotonic_increasing
    slope = np.polyfit(got["theoretical"], got["ordered"], 1)[0]
    assert got["line_slope"][0] == pytest.approx(slope)


def test_insights_and_report(spark):
    pdf = sales_frame(200)
    pdf["daily_sales"] = 1000.0 + 50 * np.arange(200)
    pdf["marketing_spend"] = pdf["daily_sales"] / 10
    profile = report.analysis(to_spark(spark, pdf.drop(index=[60])), [])
    said = [r["insight"] for r in report.insights(profile, []).orderBy("ord").collect()]
    assert said[0].startswith("Strong upward trend") and any(s.startswith("Significant growth") for s in said)
    assert "Strong correlation: marketing_spend (r=1.000)" in said and said[-1] == "Warning: 1 date gaps found"
    lines = {(r["section"], r["label"]): r["value"] for r in report.section_report(profile, []).collect()}
    assert lines[("5. DATA QUALITY", "Date Gaps")] == "1"
    assert lines[("4. TOP CORRELATIONS", "marketing_spend")] == "1.0000"


def test_wide_correlations_equal_pairwise_ones(spark):
    """300 columns with gaps, constants, NaN and large offsets; the plan does not know the pairs."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(240, 12))
    x = base @ rng.normal(size=(12, 300)) + rng.normal(size=(240, 300)) + rng.choice([0, 1e6], 300)
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 7], x[:, 8], x[1:, 9] = 5.1, np.nan, np.nan
    names = [f"v.{i}" if i == 3 else f"v{i}" for i in range(300)]
    frame = pd.DataFrame(x, columns=names).assign(k=[["a", "b", None][i % 3] for i in range(240)])
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "`" + "` double, `".join(names) + "` double, k string")
    df = df.withColumnRenamed("v.3", "v3").repartition(5)
    names[3] = "v3"
    frame.columns = [*names, "k"]
    for keys in ([], ["k"]):
        made = eda.correlation_matrix(df, keys, names)
        assert len(made._jdf.queryExecution().toString()) < 2_000_000
        got = made.toPandas()
        assert len(got) == (300 * 299 // 2) * (3 if keys else 1)
        for key, part in got.groupby(keys, dropna=False) if keys else [(None, got)]:
            rows = frame if not keys else frame[frame["k"].isna()] if key[0] is None or key[0] != key[0] else frame[frame["k"] == key[0]]
            want = rows[names].corr(min_periods=2).to_numpy()
            at = {c: i for i, c in enumerate(names)}
            w = want[[at[c] for c in part["column_a"]], [at[c] for c in part["column_b"]]]
            g = part["correlation"].to_numpy(float)
            known = ~np.isnan(w)
            constant = part["column_a"].isin(["v7", "v8", "v9"]) | part["column_b"].isin(["v7", "v8", "v9"])
            assert np.isnan(g[constant]).all()
            assert np.allclose(g[known & ~constant], w[known & ~constant], atol=1e-6)
    assert eda.correlation_matrix(df.limit(0), ["k"], names).count() == 0


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("bucket", [1, 40, 100_000])
def test_long_windows_equal_plain_ones(spark, keys, bucket):
    rng = np.random.default_rng(1)
    rows = [(i, "hot" if rng.random() < 0.8 else f"k{i % 5}", int(t), float(v)) for i, (t, v) in enumerate(zip(rng.integers(0, 900, 3000), rng.normal(size=3000)))]
    df = spark.createDataFrame(rows, "id long, k string, t long, v double").repartition(6)
    v = F.col("v")

    def columns(w, pos):
        return {"pos": pos, "lag": win.lag(v, 28, w), "ratio": win.ratio(v, 3, w), "mean": win.rolling(v, "mean", 7, w),
                "std": win.strict_rolling(v, "std", 28, w), "ma": win.moving_average(v, 5, w)}

    w = Window.partitionBy(*keys).orderBy("t", "id")
    want = df.select("*", *[c.alias(n) for n, c in columns(w, (F.row_number().over(w) - 1).cast("long")).items()])
    got = longseries.long_windows(df, keys, ["t", "id"], columns, reach=28, bucket_rows=bucket)
    pd.testing.assert_frame_equal(rows_of(got, "id"), rows_of(want, "id"), rtol=1e-9)
    assert longseries.long_windows(df.limit(0), keys, ["t", "id"], columns, 28).count() == 0


def test_long_windows_keep_tasks_small(spark):
    df = spark.range(20_000).selectExpr("id", "CAST(id AS DOUBLE) AS v")
    sizes = longseries.long_windows(df, [], ["id"], lambda w, pos: {"n": F.count("*").over(w.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing))}, reach=28, bucket_rows=1000)
    assert sizes.agg(F.max("n")).first()[0] <= 1028
