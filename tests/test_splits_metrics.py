"""Splits never leak, and metrics equal their definitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelkite.operators import metrics, reshape, sessions, splits

from conftest import rows_of

K = ["series_id"]


def folds_of(n, k, test=None, least=None):
    least = n // 2 if least is None else least
    test = (n - least) // k if test is None else test
    out = []
    for f in range(k):
        a = least + f * test
        b = min(a + test, n)
        if b <= a:
            break
        out.append((0, a, b))
    return out


@pytest.mark.parametrize("args", [{}, {"n_splits": 3, "test_size": 11}, {"test_size": 40}, {"min_train_size": 85}])
def test_walk_forward(panel, panel_pdf, args):
    out = rows_of(splits.walk_forward_split(panel, K, **args), "series_id", "fold", "date")
    for k, g in panel_pdf.groupby("series_id"):
        want = folds_of(len(g), args.get("n_splits", 5), args.get("test_size"), args.get("min_train_size"))
        mine = out[out["series_id"] == k]
        dates = sorted(g["date"])
        assert mine["fold"].nunique() == len(want)
        for f, (s, a, b) in enumerate(want):
            part = mine[mine["fold"] == f]
            assert part[part["role"] == "train"]["date"].tolist() == dates[s:a]
            assert part[part["role"] == "test"]["date"].tolist() == dates[a:b]


def test_sliding_window(panel, panel_pdf):
    info = rows_of(splits.split_info(splits.sliding_window_split(panel, K, 4, 30, 10), K), "series_id", "fold")
    assert (info["train_size"] == 30).all() and (info["test_size"] == 10).all()
    assert (pd.to_datetime(info["train_end"]) < pd.to_datetime(info["test_start"])).all()
    long = splits.sliding_window_split(panel, K, 5, 75, 10)
    assert splits.split_info(long, K).filter("series_id = 's0'").count() == 1


def test_simple_split_sizes(panel, panel_pdf):
    for ratio in (0.8, 0.7, 0.55):
        info = rows_of(splits.split_info(splits.simple_split(panel, K, ratio), K), "series_id")
        assert info["train_size"].tolist() == [int(n * ratio) for n in panel_pdf.groupby("series_id").size()]
    info = rows_of(splits.split_info(splits.simple_split(panel, K, test_size=0.3), K), "series_id")
    assert info["train_size"].tolist() == [int(n * (1 - 0.3)) for n in panel_pdf.groupby("series_id").size()]


def test_feature_target_split(panel):
    x, y = splits.feature_target_split(panel, "daily_sales")
    assert x.columns == ["series_id", "marketing_spend", "is_holiday"] and y.columns == ["daily_sales"]
    assert splits.feature_columns(panel, "daily_sales", exclude=["series_id"]) == [
        "product_category", "marketing_spend", "day_of_week", "is_holiday"]
    assert splits.feature_columns(panel, "daily_sales", ["is_holiday", "absent"]) == ["is_holiday"]


def test_metrics_match_numpy(spark):
    rng = np.random.default_rng(5)
    y, p = rng.normal(100, 20, 200), rng.normal(100, 20, 200)
    y[3] = 0.0
    df = spark.createDataFrame(pd.DataFrame({"actual": y, "predicted": p}))
    r = metrics.regression_metrics(df, []).first()
    e, ok = y - p, y != 0
    want = {
        "mae": np.abs(e).mean(), "mse": (e ** 2).mean(), "rmse": np.sqrt((e ** 2).mean()),
        "mape": np.abs(e[ok] / y[ok]).mean() * 100, "smape": (np.abs(e) / ((np.abs(y) + np.abs(p)) / 2)).mean() * 100,
        "r2": 1 - (e ** 2).sum() / ((y - y.mean()) ** 2).sum(), "explained_var": 1 - e.var() / y.var(),
        "max_error": np.abs(e).max(),
    }
    for k, v in want.items():
        assert r[k] == pytest.approx(v), k
    zero = spark.createDataFrame([(0.0, 1.0)], "actual double, predicted double")
    assert metrics.regression_metrics(zero, []).first()["mape"] == float("inf")
    clamped = spark.createDataFrame([(2.0, -1.0)], "actual double, predicted double")
    assert metrics.trainer_metrics(clamped, []).first()["mae"] == 2.0


def test_ranking(spark):
    df = spark.createDataFrame([("b", 3.0), ("a", 3.0), ("c", None), ("d", 1.0)], "model_name string, test_mape double")
    out = rows_of(metrics.rank_models(df, []), "rank")
    assert out["model_name"].tolist() == ["d", "a", "b", "c"]
    assert metrics.best_model(df, []).first()["model_name"] == "d"
    assert metrics.target_check(df, [], 0.5).first()["target_met"] is False


def test_paging_and_search(one):
    page = rows_of(reshape.paginate(one, ["date"], 10, 5, "2023-01-05", "2023-03-01"))
    assert page["date"].iloc[0].isoformat() == "2023-01-15" and len(page) == 5 and set(page["total"]) == {56}
    assert reshape.search_rows(one, "MONDAY").count() == one.filter("day_of_week = 'Monday'").count()


def test_learning_curve_padding(spark):
    df = spark.createDataFrame([("r", [3.0, 2.0, 1.0], [4.0])], "run string, train_losses array<double>, val_losses array<double>")
    out = [tuple(r) for r in reshape.zip_learning_curve(df, ["run"]).collect()]
    assert out == [("r", 1, 3.0, 4.0), ("r", 2, 2.0, None), ("r", 3, 1.0, None)]


def brute_sessions(rows, gap):
    out, last = [], {}
    for user, ts, v in sorted(rows):
        if user in last and ts - last[user][1] <= gap:
            s = last[user]
            s[1], s[2], s[3] = ts, s[2] + 1, s[3] + v
        else:
            last[user] = [ts, ts, 1, v]
            out.append((user, last[user]))
    return sorted((u, a, b, n, round(v, 6)) for u, (a, b, n, v) in out)


def test_sessions_against_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [("hot" if rng.random() < 0.4 else f"u{rng.integers(9)}", int(t), float(rng.integers(10)))
            for t in np.sort(rng.integers(0, 400_000, 900))]
    rows += [("edge", 0, 1.0), ("edge", 3600, 1.0), ("edge", 7201, 1.0)]
    df = spark.createDataFrame(rows, "user string, t long, value double").withColumn("ts", F.timestamp_seconds("t"))
    got = sorted(
        (r["user"], int(r["a"]), int(r["b"]), r["n_events"], round(r["total_value"], 6))
        for r in sessions.sessionize(df, ["user"], value="value")
        .select("*", F.unix_seconds("session_start").alias("a"), F.unix_seconds("last_event").alias("b")).collect())
    assert got == brute_sessions(rows, 3600)


def test_severity_order(spark):
    texts = ["Error: warn", "it FAILED", "warning", "complete", "hello", None]
    df = spark.createDataFrame([(t,) for t in texts], "line string")
    got = [r[0] for r in df.select(sessions.severity(F.col("line"))).collect()]
    assert got == ["error", "error", "warning", "success", "info", "info"]


def test_liveness(spark):
    df = spark.createDataFrame([("a", 0), ("b", 4000), ("c", 3900)], "id string, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = {r["id"]: (r["is_active"], r["is_stale"]) for r in sessions.liveness(df, ["id"]).collect()}
    assert got == {"a": (False, True), "b": (True, False), "c": (True, False)}
