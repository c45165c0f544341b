"""Validation, quality rows, cleaning and exact quantiles on the seeded fixtures and their mutations."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelkite.config import PanelConfig, resolve_target
from panelkite.functions import keys as keyed
from panelkite.operators import cleaning, quality, quantiles
from panelkite.operators.quantiles import exact_quantiles

from conftest import rows_of, sales_frame, to_spark


def findings(df, **kw):
    return {(r["check"], r["severity"], r["column"]): r for r in quality.validate(df, **kw).collect()}


def test_valid_frame_has_no_errors(one):
    found = findings(one)
    assert not [k for k in found if k[1] == "error"]
    assert quality.validation_summary(quality.validate(one), one).first()["is_valid"]


def test_missing_column_is_an_error(one):
    row = findings(one.drop("daily_sales"))[("schema", "error", "daily_sales")]
    assert "Missing required columns" in row["message"]


def test_null_and_negative_target(spark):
    pdf = sales_frame()
    pdf.loc[0, "daily_sales"] = None
    assert findings(to_spark(spark, pdf))[("missing", "error", "daily_sales")]["count"] == 1
    pdf.loc[0, "daily_sales"] = -100.0
    assert ("range", "error", "daily_sales") in findings(to_spark(spark, pdf))


def test_gaps_duplicates_and_flag(spark):
    pdf = sales_frame()
    gappy = pdf.drop(index=[10, 11, 12, 50])
    df = to_spark(spark, gappy)
    gaps = rows_of(quality.date_gaps(df, []), "date")
    assert gaps["gap_days"].tolist() == [4, 2]
    assert findings(df)[("date_gaps", "warning", "date")]["count"] == 2
    twice = to_spark(spark, pd.concat([pdf, pdf.iloc[[0]]]))
    found = findings(twice)
    assert found[("duplicate_dates", "error", "date")]["count"] == 1
    assert found[("duplicate_rows", "warning", None)]["count"] == 1
    pdf["is_holiday"] = pdf["is_holiday"].astype(object)
    pdf.loc[3, "is_holiday"] = None
    pdf.loc[4, "is_holiday"] = 2
    assert findings(to_spark(spark, pdf))[("binary", "error", "is_holiday")]["count"] == 2


def test_type_check(spark, one):
    text = one.withColumn("date", F.col("date").cast("string")).withColumn("daily_sales", F.col("daily_sales").cast("string"))
    kinds = {(r["severity"], r["column"]) for r in quality.type_check(text).collect()}
    assert kinds == {("warning", "date"), ("error", "daily_sales")}


def test_per_series_summary(panel):
    report = quality.validate(panel, ["series_id"])
    out = rows_of(quality.validation_summary(report, panel, ["series_id"]), "series_id")
    assert out["is_valid"].all() and len(out) == 3


@pytest.mark.parametrize("probs", [(0.0, 0.25, 0.5, 0.75, 1.0), (0.1, 0.99)])
def test_exact_quantiles_match_pandas(spark, probs):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.choice(["hot"] * 8 + ["a", "b"], 4000), "x": rng.lognormal(size=4000).round(2),
                        "y": rng.integers(0, 4, 4000).astype(float)})
    pdf.loc[::97, "x"] = np.nan
    df = spark.createDataFrame(pdf)
    # A coarse sketch forces wide brackets and the fallback; the answer must not change.
    for accuracy in (10_000, 20):
        got = {(r["k"], r["column"], r["prob"]): r["value"]
               for r in exact_quantiles(df, ["k"], ["x", "y"], probs, accuracy).collect()}
        for k, part in pdf.groupby("k"):
            for c in ("x", "y"):
                for p in probs:
                    assert got[(k, c, p)] == pytest.approx(part[c].quantile(p), rel=1e-12)


def test_quantile_ranking_is_cut_into_ranges(spark):
    """One group with nearly all rows on one value, one without ties: no range holds a whole group."""
    n = 20_000
    rows = spark.range(n).select(
        F.explode(F.array(
            F.struct(F.lit("ties").alias("k"), F.when(F.col("id") % 20 == 0, F.col("id")).otherwise(7).cast("double").alias("v")),
            F.struct(F.lit("none").alias("k"), ((F.col("id") * 7919) % n).cast("double").alias("v")),
        )).alias("r")).select("r.*")
    counted = rows.groupBy("k", "v").agg(F.count("*").alias("c")).withColumn("below", F.lit(5))
    got = quantiles._running(counted, ["k"]).toPandas()
    for k, part in got.groupby("k"):
        part = part.sort_values("v")
        assert (part["upto"].to_numpy() == 5 + part["c"].cumsum().to_numpy()).all()
    assert got[got["k"] == "none"].groupby("__part").size().max() < n / 2
    found = {(r["k"], r["prob"]): r["value"] for r in exact_quantiles(rows.withColumnRenamed("v", "x"), ["k"], ["x"], (0.5, 0.99)).collect()}
    want = rows.toPandas()
    for (k, p), value in found.items():
        assert value == pytest.approx(want.loc[want["k"] == k, "v"].quantile(p))


def test_sketched_quartiles_keep_their_rank(spark):
    n, accuracy = 20_000, 200
    rows = spark.range(n).select(F.lit("k").alias("k"), ((F.col("id") * 7919) % n).cast("double").alias("x"))
    rows = rows.withColumn("y", F.when(F.col("x") % 2 == 0, F.col("x")).otherwise(F.lit(float("nan"))))
    got = {r["column"]: r for r in quality.iqr_bounds(rows, ["k"], ["x", "y"], accuracy=accuracy).collect()}
    for r in got.values():
        assert abs(r["q1"] / n - 0.25) <= 1.5 / accuracy and abs(r["q3"] / n - 0.75) <= 1.5 / accuracy
        assert r["lower_bound"] == r["q1"] - 1.5 * (r["q3"] - r["q1"])
    none = quality.iqr_outliers(rows.limit(0), ["k"], ["x"], accuracy=accuracy)
    assert none.count() == 0


def test_statistics_join_alike_beyond_the_byte_bound(spark, panel, monkeypatch):
    keys = ["series_id"]
    stats = panel.groupBy(*keys).agg(F.avg("daily_sales").alias("mu"), F.collect_set("is_holiday").alias("flags"))
    held = keyed.bytes_held(stats)
    longer = stats.withColumn("series_id", F.rpad("series_id", 1000, "x"))
    assert 3 * keyed.ROW_BYTES < held < 2_000 and keyed.bytes_held(longer) > held + 2_900
    small = keyed.attach_rows(panel, stats, keys)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(keyed, "BROADCAST_BYTES", held - 1)
    large = keyed.attach_rows(panel, stats, keys)
    order = ["series_id", "date"]
    pd.testing.assert_frame_equal(rows_of(small.drop("flags"), *order), rows_of(large.drop("flags"), *order))
    assert keyed.bytes_held(stats.limit(0)) == 0


def test_quantiles_of_empty_and_null_groups(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1.0)], "k string, x double")
    assert [tuple(r) for r in exact_quantiles(df, ["k"], ["x"], (0.5,)).collect()] == [("b", "x", 0.5, 1.0)]
    assert exact_quantiles(df.limit(0), ["k"], ["x"]).count() == 0


def test_names_and_types(spark):
    df = spark.createDataFrame([("2023-01-01", "12.5", "oops")], ["Date", " Daily Sales", "Marketing Spend"])
    named = cleaning.standardize_names(df)
    assert named.columns == ["date", "daily_sales", "marketing_spend"]
    row = cleaning.clean(df).first()
    assert (row["date"], row["daily_sales"], row["marketing_spend"]) == (dt.date(2023, 1, 1), 12.5, None)


def test_date_formats_never_raise(spark):
    texts = ["2023-01-31", "2023/01/31", "01/31/2023", "31-01-2023", "20230131", "2023-01-31 10:00:00", "soon", None]
    df = spark.createDataFrame([(t,) for t in texts], "date string")
    got = [r["date"] for r in cleaning.parse_dates(df).collect()]
    assert got == [dt.date(2023, 1, 31)] * 6 + [None, None]


def test_clean_keeps_rows_and_drops_the_copy(spark):
    pdf = sales_frame()
    out = cleaning.clean(to_spark(spark, pd.concat([pdf, pdf.iloc[[0]]])))
    assert out.count() == 100 and dict(out.dtypes)["date"] == "date"


def test_input_order_decides_between_duplicates(spark, folder):
    spark.createDataFrame([("2023-01-01", 5.0), ("2023-01-01", 1.0)], "date string, daily_sales double").coalesce(1).write.parquet(folder + "/d")
    scan = cleaning.with_file_order(spark.read.parquet(folder + "/d"))
    assert cleaning.clean(scan, order=cleaning.FILE_ORDER).first()["daily_sales"] == 5.0


def test_fills_match_pandas(spark, panel_pdf):
    pdf = panel_pdf.copy()
    rng = np.random.default_rng(0)
    pdf.loc[rng.random(len(pdf)) < 0.3, "marketing_spend"] = None
    pdf["product_category"] = rng.choice(["b", "a", None], len(pdf), p=[0.4, 0.4, 0.2])
    df = to_spark(spark, pdf, keyed=True)
    got = rows_of(cleaning.clean(df, ["series_id"]), "series_id", "date")
    want = pdf.sort_values(["series_id", "date"]).copy()
    want["marketing_spend"] = want.groupby("series_id")["marketing_spend"].transform(lambda s: s.ffill().bfill())
    want["product_category"] = want.groupby("series_id")["product_category"].transform(lambda s: s.fillna(s.mode().iloc[0]))
    assert np.allclose(got["marketing_spend"], want["marketing_spend"].astype(float))
    assert got["product_category"].tolist() == want["product_category"].tolist()


@pytest.mark.parametrize("method", ["clip", "remove"])
def test_outliers_match_pandas(spark, method):
    pdf = sales_frame()
    pdf.loc[[5, 20, 70], "daily_sales"] = [500_000.0, -300_000.0, 400_000.0]
    pdf.loc[9, "marketing_spend"] = 90_000.0
    got = rows_of(cleaning.handle_outliers(to_spark(spark, pdf), [], method=method, n_std=2.0), "date")
    want = pdf.copy()
    for c in ("daily_sales", "marketing_spend"):
        lo, hi = want[c].mean() - 2 * want[c].std(), want[c].mean() + 2 * want[c].std()
        want = want.assign(**{c: want[c].clip(lo, hi)}) if method == "clip" else want[~((want[c] < lo) | (want[c] > hi))]
    assert np.allclose(got["daily_sales"], want["daily_sales"]) and len(got) == len(want)


def test_cleaning_report(spark):
    pdf = sales_frame()
    pdf.loc[4, "marketing_spend"] = None
    raw = to_spark(spark, pd.concat([pdf, pdf.iloc[[0]]])).withColumnRenamed("day_of_week", "Day Of Week")
    counts = {r["operation"]: r["count"] for r in cleaning.cleaning_report(raw, cleaning.clean(raw), []).collect()}
    assert counts == {"renamed_columns": 1, "rows_without_date": 0, "duplicate_rows_removed": 1, "values_filled": 1}


def test_quality_report_and_check(spark):
    pdf = sales_frame()
    pdf.loc[2, "marketing_spend"] = None
    df = to_spark(spark, pdf.drop(index=[30]))
    rep = {r["column"]: r for r in quality.quality_report(df).collect()}
    x = pdf.drop(index=[30])["daily_sales"]
    r = rep["daily_sales"]
    assert r["skewness"] == pytest.approx(x.skew()) and r["kurtosis"] == pytest.approx(x.kurtosis())
    assert r["median"] == pytest.approx(x.median()) and rep["marketing_spend"]["nulls"] == 1
    kinds = {(q["kind"], q["name"]): q["count"] for q in quality.quality_check(df).collect()}
    assert kinds == {("missing", "marketing_spend"): 1, ("duplicates", "rows"): 0, ("date_gap", "2023-02-01"): 2}


def test_upload_check(spark):
    good = spark.createDataFrame([("2023-01-01", "5")], "date string, daily_sales string")
    bad = spark.createDataFrame([("2023-01-01", "x"), ("never", "5")], "date string, daily_sales string")
    assert quality.upload_check(good).first()["accepted"]
    row = quality.upload_check(bad).first()
    assert not row["accepted"] and (row["bad_dates"], row["bad_targets"]) == (1, 1)
    assert quality.upload_check(good.drop("daily_sales")).first()["missing_columns"] == "daily_sales"


def test_degenerate_frames(spark, one):
    for df in (one.limit(0), one.limit(1)):
        quality.validate(df).collect()
        cleaning.clean(df).collect()
        quality.summary_statistics(df, []).collect()
    assert quality.summary_statistics(one.limit(1), []).first()["std"] is None


def test_config_defaults_and_overrides(spark):
    assert PanelConfig().lag_days == (1, 7, 14, 28) and PanelConfig().target_col == "daily_sales"
    assert PanelConfig(lag_days=[1, 7], rolling_windows=[7]).rolling_windows == (7,)
    df = spark.createDataFrame([(1, 2.0)], "id int, net_sales double")
    assert resolve_target(df) == "net_sales"
