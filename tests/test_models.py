"""Models against closed forms, known parameters, and brute-force recursion."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from panelkite.models import arima, decomposable, linear, search, trees
from panelkite.models.base import Fitted, robust_sigma
from panelkite.models.ensemble import ensemble
from panelkite.operators.splits import walk_forward_split
from panelkite.models.registry import MODELS, fit_models, forecast_all, resolve, sample_params
from panelkite.plans import queries, training
from panelkite.plans.forecasting import request_forecast, response
from panelkite.plans.training import train_all

from conftest import rows_of, to_spark, sales_frame

K = ["series_id"]
WEEK = np.array([0, 5, 10, 15, 20, 60, 50.0])


def trend_panel(spark, n=400, noise=1.0, level=500.0, keys=("a", "b")):
    parts = []
    for i, k in enumerate(keys):
        pdf = sales_frame(n, seed=i)
        dow = pd.to_datetime(pdf["date"]).dt.dayofweek
        rng = np.random.default_rng(i)
        pdf["daily_sales"] = level + (1 + i) * np.arange(n) * 0.5 + WEEK[dow] + rng.normal(0, noise, n)
        parts.append(pdf.assign(series_id=k))
    pdf = pd.concat(parts, ignore_index=True)
    pdf = pdf[["series_id", *[c for c in pdf.columns if c != "series_id"]]]
    return to_spark(spark, pdf, keyed=True), pdf


def design_forecast(pdf, include_dow, alpha, h):
    n = len(pdf)
    days = pd.date_range(pdf["date"].min(), periods=n + h)
    x = np.arange(n + h, dtype=float)[:, None]
    if include_dow:
        x = np.hstack([x, np.eye(7)[days.dayofweek]])
    mu, sd = x[:n].mean(0), x[:n].std(0)
    z = (x - mu) / np.where(sd < 1e-12, 1, sd)
    y = pdf["daily_sales"].to_numpy()
    zc = z[:n] - z[:n].mean(0)
    if alpha:
        beta = np.linalg.solve(zc.T @ zc + alpha * np.eye(x.shape[1]), zc.T @ (y - y.mean()))
    else:
        beta = np.linalg.lstsq(zc, y - y.mean(), rcond=None)[0]
    return (y.mean() + z @ beta)[n:]


@pytest.mark.parametrize("include_dow,alpha", [(True, 0.0), (False, 0.0), (True, 7.5), (False, 30.0)])
def test_linear_equals_dense_solution(spark, include_dow, alpha):
    df, pdf = trend_panel(spark, 150, noise=20.0)
    f = linear.fit(df, K, {"include_dow": include_dow, "regularization": alpha})
    got = rows_of(linear.forecast(f, 21), "series_id", "date")
    for k, g in pdf.groupby("series_id"):
        assert np.allclose(got[got["series_id"] == k]["predicted"], design_forecast(g, include_dow, alpha, 21), rtol=1e-8)
    assert (got["lower_bound"] <= got["predicted"]).all() and (got["predicted"] <= got["upper_bound"]).all()


def test_forecast_dates_follow_the_history(spark):
    df, pdf = trend_panel(spark, 60)
    got = rows_of(linear.forecast(linear.fit(df, K), 5), "series_id", "day_number")
    last = pdf["date"].max()
    assert got["date"].tolist() == [last + dt.timedelta(days=i) for i in range(1, 6)] * 2
    with pytest.raises(ValueError):
        linear.forecast(linear.fit(df, K), 366)
    plain = linear.forecast(linear.fit(df, K), 3, include_ci=False).first()
    assert plain["lower_bound"] is None


@pytest.mark.parametrize("keys", [K, []])
def test_forecasts_from_newer_data_count_the_gap(spark, keys):
    df, pdf = trend_panel(spark, 60, keys=("a", "b") if keys else ("a",))
    df = df if keys else df.drop("series_id")
    fitted = fit_models(df, keys, [linear.NAME])
    last = pdf["date"].max()
    newest = df.groupBy(*keys).agg(F.date_add(F.max("date"), 9).alias("last_date"))
    far = rows_of(request_forecast(fitted, linear.NAME, 14), *keys, "date")
    for model in (linear.NAME, "all"):
        got = rows_of(request_forecast(fitted, model, 5, newest=newest), *keys, "date")
        assert list(got["day_number"]) == [1, 2, 3, 4, 5] * (len(got) // 5)
        assert pd.to_datetime(got["date"]).min() == pd.Timestamp(last) + pd.Timedelta(days=10)
        assert list(got["predicted"]) == pytest.approx(list(far.loc[far["day_number"] > 9, "predicted"]))
    older = newest.withColumn("last_date", F.date_sub("last_date", 30))
    assert rows_of(request_forecast(fitted, linear.NAME, 14, newest=older), *keys, "date").equals(far)


def test_predictions_never_negative(spark):
    df, _ = trend_panel(spark, 100)
    down = df.withColumn("daily_sales", F.lit(1000.0) - 10 * F.datediff("date", F.lit("2023-01-01").cast("date")))
    got = rows_of(linear.forecast(linear.fit(down, K), 10))
    # The first day's line is 0 itself, so its clamped value may be a rounding error above 0.
    assert (got["predicted"] >= 0).all() and (got["predicted"] < 1e-9).all() and (got["lower_bound"] == 0).all()


def test_robust_sigma(spark):
    r = np.random.default_rng(2).normal(0, 3, 500)
    df = spark.createDataFrame(pd.DataFrame({"residual": r}))
    assert robust_sigma(df, []).first()[0] == pytest.approx(1.4826 * np.median(np.abs(r - np.median(r))))


def test_decomposable_recovers_trend_and_week(spark):
    df, pdf = trend_panel(spark, 500, noise=2.0)
    for mode in ("additive", "multiplicative"):
        f = decomposable.fit(df, K, {"mode": mode, "yearly": False})
        got = rows_of(decomposable.forecast(f, 28), "series_id", "date")
        for i, k in enumerate("ab"):
            days = np.arange(500, 528)
            dow = pd.to_datetime(got[got["series_id"] == k]["date"]).dt.dayofweek
            want = 500 + (1 + i) * days * 0.5 + WEEK[dow]
            assert np.abs(got[got["series_id"] == k]["predicted"] / want - 1).max() < 0.05, mode
    assert (got["lower_bound"] < got["predicted"]).all()


def test_decomposable_holiday_effect(spark):
    df, _ = trend_panel(spark, 400, noise=0.5)
    lifted = df.withColumn("daily_sales", F.col("daily_sales") + 300 * F.col("is_holiday"))
    f = decomposable.fit(lifted, K, {"mode": "additive", "yearly": False})
    day = dt.date(2024, 2, 10)
    marked = spark.createDataFrame([("a", day)], "series_id string, date date")
    base = {(r["series_id"], r["date"]): r["predicted"] for r in decomposable.forecast(f, 30).collect()}
    with_h = {(r["series_id"], r["date"]): r["predicted"] for r in decomposable.forecast(f, 30, holidays=marked).collect()}
    moved = {k: with_h[k] - base[k] for k in base if abs(with_h[k] - base[k]) > 1e-9}
    assert list(moved) == [("a", day)] and moved[("a", day)] == pytest.approx(300, rel=0.05)


def test_arima_recovers_known_parameters():
    rng = np.random.default_rng(7)
    e, y = rng.normal(0, 1, 6000), np.zeros(6000)
    for t in range(1, 6000):
        y[t] = 5.0 + 0.6 * y[t - 1] + e[t] + 0.3 * e[t - 1]
    s = arima.fit_arrays(y, {"p": 1, "d": 0, "q": 1, "P": 0, "D": 0, "Q": 0, "trend": "c"})
    assert s["ar"][0] == pytest.approx(0.6, abs=0.05) and s["ma"][0] == pytest.approx(0.3, abs=0.05)
    assert s["sigma"] == pytest.approx(1.0, abs=0.03)
    mean, se = arima.predict_arrays(s, 200)
    assert mean[-1] == pytest.approx(12.5, abs=0.4)
    assert se[-1] == pytest.approx(np.sqrt(1 + 0.9 ** 2 / (1 - 0.36)), abs=0.08)


def test_arima_seasonal_difference_repeats_the_week():
    y = np.tile(np.arange(7.0), 30) + 0.0
    s = arima.fit_arrays(y, {"p": 0, "d": 0, "q": 0, "P": 0, "D": 1, "Q": 0, "trend": "n"})
    assert np.allclose(arima.predict_arrays(s, 14)[0], np.tile(np.arange(7.0), 2))
    walk = arima.fit_arrays(np.arange(50.0) ** 1.0, {"p": 0, "d": 1, "q": 0, "P": 0, "D": 0, "Q": 0, "trend": "c"})
    assert np.allclose(arima.predict_arrays(walk, 3)[0], [50, 51, 52])


def test_arima_steps_many_series_together():
    """Series of mixed orders and lengths, each against its own recursion."""
    rng = np.random.default_rng(7)
    orders = [{}, {"q": 2, "D": 1}, {"p": 0, "d": 0, "q": 0, "trend": "c"}, {"p": 2, "q": 0}, {"P": 1, "Q": 1}]
    states = [arima.fit_arrays(100 + rng.normal(size=n).cumsum(), arima.DEFAULTS | o) for o in orders for n in (60, 90)]
    states.append(arima._last_value(np.array([4.0])))
    mean, se = arima.predict_frame(pd.DataFrame(states), 40)
    for s, m, d in zip(states, mean, se):
        y, e, psi = list(s["y_tail"]), list(s["e_tail"]), [1.0]
        for h in range(1, 41):
            y.append(s["const"] + s["slope"] * (s["t_last"] + h)
                     + sum(a * y[-i - 1] for i, a in enumerate(s["ar"])) + sum(c * e[-i - 1] for i, c in enumerate(s["ma"])))
            e.append(0.0)
            psi.append((s["ma"][h - 1] if h <= len(s["ma"]) else 0.0) + sum(a * psi[-i - 1] for i, a in enumerate(s["ar"]) if i < h))
        assert m == pytest.approx(y[-40:], rel=1e-9)
        assert d == pytest.approx(s["sigma"] * np.sqrt(np.cumsum(np.square(psi[:40]))), rel=1e-9)


def test_arima_panel_and_short_series(spark):
    df, _ = trend_panel(spark, 200, noise=2.0)
    short = df.filter("series_id = 'a' OR date <= '2023-01-02'")
    got = rows_of(arima.forecast(arima.fit(short, K), 7), "series_id", "date")
    assert set(got["series_id"]) == {"a", "b"} and got["upper_bound"].gt(got["lower_bound"]).all()
    left = rows_of(arima.forecast(arima.fit(short, K, keep_short=False), 7), "series_id", "date")
    assert set(left["series_id"]) == {"a"}


@pytest.fixture(scope="module")
def forest(spark):
    df, pdf = trend_panel(spark, 220, noise=3.0)
    return df, pdf, {m: trees.fit(df, K, m, {"n_estimators": 6, "max_depth": 4}, curve=True) for m in (trees.BOOSTED, trees.FOREST)}


@pytest.mark.parametrize("model", [trees.BOOSTED, trees.FOREST])
def test_node_arrays_equal_the_model(spark, model):
    pdf = pd.DataFrame(np.random.default_rng(3).random((500, 12)), columns=trees.FEATURES)
    pdf["y"] = pdf["lag_1"] * 10 + pdf["month"]
    rows = VectorAssembler(inputCols=trees.FEATURES, outputCol="features").transform(spark.createDataFrame(pdf))
    trained = trees._estimator(model, trees.DEFAULTS[model] | {"n_estimators": 5, "max_depth": 4}, "y").fit(rows)
    packed = trees.pack_nodes(trees.node_table(trained, model))
    mine = trees.tree_values(packed, pdf[trees.FEATURES].to_numpy()) @ packed["weight"]
    theirs = trained.transform(rows).toPandas()
    order = theirs.set_index("lag_1")["prediction"]
    assert np.allclose(mine, order.loc[pdf["lag_1"]].to_numpy())


@pytest.mark.parametrize("model", [trees.BOOSTED, trees.FOREST])
def test_recursive_forecast_equals_one_step_at_a_time(spark, forest, model):
    df, pdf, fitted = forest
    f = fitted[model]
    got = rows_of(trees.forecast(f, 10), "series_id", "date")
    packed = trees.pack_nodes(f.nodes)
    for k, g in pdf.groupby("series_id"):
        values = g["daily_sales"].tolist()
        day = g["date"].max()
        for step in range(10):
            day += dt.timedelta(days=1)
            v = np.array(values)
            x = [v[-1], v[-7], v[-14], v[-28], v[-7:].mean(), v[-14:].mean(), v[-7:].std(ddof=1), v[-14:].std(ddof=1),
                 day.weekday(), day.month, day.timetuple().tm_yday, len(v)]
            values.append(max(float((trees.tree_values(packed, np.array([x])) @ packed["weight"])[0]), 0.0))
        assert np.allclose(got[got["series_id"] == k]["predicted"], values[-10:])


def test_tree_importances_curve_and_verdict(forest):
    _, _, fitted = forest
    for f in fitted.values():
        imp = rows_of(f.importances, "importance_rank")
        assert len(imp) == 12 and imp["importance_score"].sum() == pytest.approx(1.0)
        assert imp["importance_score"].is_monotonic_decreasing
        assert f.curve.count() >= 1
        assert trees.curve_verdict(f.curve).first()["verdict"] in ("overfitting", "underfitting", "good_fit")


def test_models_survive_saving(spark, forest, folder):
    df, _, fitted = forest
    for name, f in {**fitted, "linear_trend": linear.fit(df, K), "seasonal_arima": arima.fit(df, K)}.items():
        f.save(f"{folder}/{name}")
        again = Fitted.load(spark, f"{folder}/{name}")
        a, b = (rows_of(resolve(name).forecast(m, 5), "series_id", "date") for m in (f, again))
        pd.testing.assert_frame_equal(a, b)


def test_ensemble_lies_between_members(spark):
    df, _ = trend_panel(spark, 120)
    fitted = fit_models(df, K, ["linear_trend", "seasonal_arima"])
    every = forecast_all(fitted, 7)
    mixed = rows_of(ensemble(every, K), "series_id", "date")
    lo = rows_of(every.groupBy("series_id", "date").agg(F.min("predicted").alias("v")), "series_id", "date")["v"]
    hi = rows_of(every.groupBy("series_id", "date").agg(F.max("predicted").alias("v")), "series_id", "date")["v"]
    assert ((mixed["predicted"] >= lo - 1e-9) & (mixed["predicted"] <= hi + 1e-9)).all()
    only = rows_of(ensemble(every, K, {"linear_trend": 2.0}), "series_id", "date")
    alone = rows_of(linear.forecast(fitted["linear_trend"], 7), "series_id", "date")
    assert np.allclose(only["predicted"], alone["predicted"])
    with pytest.raises(ValueError):
        ensemble(every, K, {"linear_trend": 0.0})


def fold_rows(spark, df, n_folds):
    """The folds of the split operator: per series and fold the training and test rows in order of date."""
    out = {}
    pdf = walk_forward_split(df, K, n_folds).toPandas().sort_values("date")
    for (k, f), g in pdf.groupby(["series_id", "fold"]):
        out[k, f] = (g[g["role"] == "train"], g[g["role"] == "test"])
    return out


def mape(y, p):
    return np.abs((y - p) / y).mean() * 100


def test_linear_search_equals_fitting_each_candidate(spark):
    df, _ = trend_panel(spark, 151, noise=30.0)
    scores, candidates = search.score(df, K, "linear_trend", 6)
    got = {(r["series_id"], r["trial"]): r["mape"] for r in scores.collect()}
    folds = fold_rows(spark, df, search.N_FOLDS)
    for k in "ab":
        for i, c in enumerate(candidates):
            errors = []
            for f in range(search.N_FOLDS):
                train, test = folds[k, f]
                p = design_forecast(train, c["include_dow"], c["regularization"], len(test))
                errors.append(mape(test["daily_sales"].to_numpy(), np.maximum(p, 0)))
            assert got[(k, i)] == pytest.approx(np.mean(errors), rel=1e-6)
    best = {r["series_id"]: r["mape"] for r in search.best_params(scores, K, candidates).collect()}
    assert best == {k: min(v for (s, _), v in got.items() if s == k) for k in "ab"}


@pytest.mark.parametrize("name", ["decomposable", "seasonal_arima"])
def test_kernel_search_equals_a_loop_over_the_folds(spark, name):
    df, _ = trend_panel(spark, 163, noise=30.0)
    scores, candidates = search.score(df, K, name, 4)
    got = {(r["series_id"], r["trial"]): r["mape"] for r in scores.collect()}
    model = resolve(name)
    folds = fold_rows(spark, df, search.N_FOLDS)
    for i, c in enumerate(candidates):
        errors = {k: [] for k in "ab"}
        for f in range(search.N_FOLDS):
            train = pd.concat([folds[k, f][0] for k in "ab"])
            fitted = model.fit(spark.createDataFrame(train.drop(columns=["fold", "role"])), K, params=c)
            known = {"holidays": df.filter("is_holiday = 1").select("series_id", "date")} if name == "decomposable" else {}
            ahead = model.forecast(fitted, 60, include_ci=False, **known).toPandas()
            for k in "ab":
                test = folds[k, f][1]
                p = ahead[(ahead["series_id"] == k) & ahead["date"].isin(test["date"])].sort_values("date")["predicted"].to_numpy()
                errors[k].append(mape(test["daily_sales"].to_numpy(), p))
        for k in "ab":
            assert got[(k, i)] == pytest.approx(np.mean(errors[k]), rel=1e-6)


@pytest.mark.parametrize("name", ["linear_trend", "decomposable", "seasonal_arima", "boosted_trees"])
def test_search_does_not_look_ahead(spark, name, monkeypatch):
    """Rows after the last fold's test block, and the size of the series beyond it, change nothing: nor do other series."""
    monkeypatch.setattr(search, "sample_params", lambda spec, n, seed: [spec.defaults | {"n_estimators": 3, "max_depth": 3}][:n])
    df, _ = trend_panel(spark, 160, noise=30.0)
    assert search.folds_of(160, 3) == [(80, 106), (106, 132), (132, 158)]
    plain = {r["series_id"]: r["mape"] for r in search.score(df, K, name, 1)[0].collect()}
    last = df.agg(F.max("date")).first()[0]
    odd = df.withColumn("daily_sales", F.when(F.datediff(F.lit(last), "date") < 2, 1e9).otherwise(F.col("daily_sales")))
    assert {r["series_id"]: r["mape"] for r in search.score(odd, K, name, 1)[0].collect()} == pytest.approx(plain)


def test_a_search_of_one_series_is_spread(spark):
    df, _ = trend_panel(spark, 90, keys=("a",))
    one = df.drop("series_id")
    for name in ("decomposable", "seasonal_arima", "linear_trend"):
        scores, _ = search.score(one, [], name, 10)
        assert scores.count() == 10 and scores.filter("mape IS NOT NULL").count() == 10
        if name != "linear_trend":
            assert scores.rdd.getNumPartitions() >= 8
    short, _ = search.score(one.limit(1), [], "decomposable", 3)
    assert [r["mape"] for r in short.collect()] == [None] * 3


@pytest.mark.parametrize("name", ["decomposable", "seasonal_arima"])
def test_kernel_search(spark, name):
    df, _ = trend_panel(spark, 200, noise=5.0)
    scores, candidates = search.score(df, K, name, 5)
    assert scores.count() == 10
    best = search.best_params(scores, K, candidates)
    assert best.filter("mape < 10").count() == 2
    assert search.best_overall(scores, candidates) in candidates


def test_global_search_ranks_failures_last(spark, monkeypatch):
    df, _ = trend_panel(spark, 160, noise=5.0)
    trials = [{"n_estimators": 3, "max_depth": 3}, {"n_estimators": 3, "max_depth": 99}]
    monkeypatch.setattr(search, "sample_params", lambda *a: trials)
    scores, candidates = search.score(df, K, "random_forest", 2)
    got = {(r["series_id"], r["trial"]): r["mape"] for r in scores.collect()}
    assert len(got) == 4 and got[("a", 0)] is not None and got[("a", 1)] is None
    assert search.best_overall(scores, candidates) == trials[0]
    assert {r["trial"] for r in search.best_params(scores, K, candidates).collect()} == {0}


def test_best_round_waits_for_patience():
    losses = [9, 5, 4, 4.5, 4.2, 4.1, 3.9, 4, 4, 4]
    assert [trees.best_round(losses, n) for n in (1, 3, 4, 20)] == [3, 3, 7, 7]
    assert trees.best_round([5.0, 4.0, 3.0], 20) == 3 and trees.best_round([float("nan")] * 4, 2) == 4


def test_boosting_rounds_follow_the_hold_out_loss(spark):
    df, _ = trend_panel(spark, 200, noise=80.0)
    params = {"n_estimators": 30, "max_depth": 3, "learning_rate": 0.5, "patience": 4}
    fitted = trees.fit(df, K, trees.BOOSTED, params, curve=True)
    losses = [r["val_loss"] ** 2 for r in fitted.curve.orderBy("iteration").collect()]
    rows = trees.assemble(trees.lag_matrix(df, K), "daily_sales")
    _, honest, _ = trees.fit_rows(rows, trees.BOOSTED, trees.DEFAULTS[trees.BOOSTED] | params, "daily_sales")
    held = rows.filter("is_holdout")
    own = trees.round_losses(honest, held, trees.BOOSTED, "daily_sales", {}).orderBy("iteration").collect()
    assert np.allclose([r["sse"] / r["n"] for r in own], honest.evaluateEachIteration(held, "squared"), rtol=1e-9)
    assert len(losses) == 30 and fitted.info["rounds"] == trees.best_round(losses, 4) < 30
    assert fitted.nodes.select("tree").distinct().count() == fitted.info["rounds"]


def test_small_nodes_are_not_split(spark):
    df, _ = trend_panel(spark, 200, noise=80.0)
    params = {"n_estimators": 6, "max_depth": 8, "min_samples_leaf": 1}
    loose, strict = (trees.fit(df, K, trees.FOREST, params | {"min_samples_split": n}) for n in (2, 40))
    inner = strict.nodes.filter("feature >= 0")
    assert inner.count() > 6 and inner.agg(F.min("n_rows")).first()[0] >= 40 > loose.nodes.filter("feature >= 0").agg(F.min("n_rows")).first()[0]
    # The nodes of the first forest, walked with the rule applied on the way, give the second one's predictions.
    nodes = {(r["tree"], r["node"]): r for r in loose.nodes.collect()}
    x = rows_of(trees.lag_matrix(df, K).dropna(), "series_id", "date")
    want = []
    for row in x[list(trees.FEATURES)].to_numpy():
        total = 0.0
        for tree in range(6):
            at = nodes[tree, 0]
            while at["feature"] >= 0 and at["n_rows"] >= 40:
                at = nodes[tree, at["left"] if row[at["feature"]] <= at["threshold"] else at["right"]]
            total += at["value"] * at["weight"]
        want.append(total)
    got = rows_of(trees.in_sample(df, strict), "series_id", "date")["predicted"]
    assert np.allclose(got, want)


def test_sparse_changepoints_meet_the_optimality_conditions():
    rng = np.random.default_rng(5)
    for _ in range(30):
        x = rng.normal(size=(60, 12)).cumsum(axis=0)
        y = x @ np.where(rng.random(12) < 0.3, rng.normal(size=12), 0) + rng.normal(size=60)
        gram, rhs, ridge, weight = x.T @ x, x.T @ y, np.full(12, 0.5), float(rng.choice([0.1, 10.0, 500.0]))
        beta = decomposable.penalised(gram, rhs, ridge, slice(2, 9), weight)
        slope = rhs - gram @ beta
        smooth = [0, 1, 9, 10, 11]
        assert np.allclose(slope[smooth], (ridge * beta)[smooth], atol=1e-5 * np.abs(rhs).max())
        for k in range(2, 9):
            if beta[k]:
                assert slope[k] == pytest.approx(weight * np.sign(beta[k]), rel=1e-4, abs=1e-4)
            else:
                assert abs(slope[k]) <= weight * (1 + 1e-5)


def test_unused_changepoints_are_exactly_zero(spark):
    days = np.arange(19_000.0, 19_400.0)
    bend = 100 + 0.5 * (days - days[0]) + 3.0 * np.maximum(days - 19_200, 0)
    p = decomposable.DEFAULTS | {"mode": "additive", "yearly": False}
    s = decomposable.fit_arrays(days, bend + np.random.default_rng(1).normal(0, 2, 400), np.zeros(400), p)
    steps = s["coef"][2:27]
    assert 0 < np.count_nonzero(steps) < 15
    near = np.abs(np.asarray(s["changepoints"]) - 200 / 399) < 0.1
    assert np.abs(steps[near]).sum() > 0.7 * np.abs(steps).sum()
    flat = decomposable.fit_arrays(days, 10 + np.random.default_rng(2).normal(0, 1, 400), np.zeros(400), p)
    assert np.count_nonzero(flat["coef"][2:27]) <= 3


def test_intervals_widen_and_cover(spark):
    """Random-walk slopes: the interval must grow with the horizon and hold about its share of the later values."""
    hits, widths = [], []
    for k in range(40):
        rng = np.random.default_rng(k)
        turns = np.where(rng.random(460) < 0.06, rng.laplace(0, 0.3, 460), 0)
        turns[320:400] = 0  # the model looks for changes in the first 80 % of the history
        y = 1000 + np.cumsum(np.cumsum(turns) + 1.0) + rng.normal(0, 3, 460)
        days = np.arange(19_000.0, 19_460.0)
        s = decomposable.fit_arrays(days[:400], y[:400], np.zeros(400), decomposable.DEFAULTS | {"mode": "additive", "yearly": False, "changepoint": 0.5})
        base = decomposable.predict_arrays(s, days[400:])
        low, high = decomposable.simulated_bounds(s, base, 0.9, [1, k], 400)
        hits.append((decomposable.to_natural(s, low) <= y[400:]) & (y[400:] <= decomposable.to_natural(s, high)))
        widths.append(high - low)
    assert 0.75 <= np.mean(hits) <= 0.97
    assert np.mean([w[-1] for w in widths]) > 1.5 * np.mean([w[0] for w in widths])


def test_intervals_do_not_depend_on_partitions(spark):
    df, _ = trend_panel(spark, 150, noise=20.0)
    fitted = decomposable.fit(df, K)
    one = rows_of(decomposable.forecast(fitted, 20), "series_id", "date")
    fitted.series = fitted.series.repartition(7)
    pd.testing.assert_frame_equal(one, rows_of(decomposable.forecast(fitted, 20), "series_id", "date"))
    mixed = df.withColumn("daily_sales", F.when((F.col("series_id") == "a") & (F.dayofmonth("date") == 3), 0.0).otherwise(F.col("daily_sales")))
    modes = {r["series_id"]: r["mode"] for r in decomposable.fit(mixed, K).series.collect()}
    assert modes == {"a": "additive, as a value is not positive", "b": "multiplicative"}


def test_no_model_loses_a_series(spark):
    rows = [(k, d, 100.0 + (i % 7)) for k, n in (("one", 1), ("five", 5), ("twenty", 20), ("long", 400))
            for i, d in enumerate(pd.date_range("2022-01-01", periods=n).date)]
    df = spark.createDataFrame(rows, "series_id string, date date, daily_sales double")
    small = {"boosted_trees": {"n_estimators": 3, "max_depth": 2}, "random_forest": {"n_estimators": 3, "max_depth": 3}}
    ahead = forecast_all(fit_models(df, K, params=small), 6).groupBy("series_id", "model").count().collect()
    assert len(ahead) == 20 and {r["count"] for r in ahead} == {6}


def test_candidates_are_seeded_and_in_range():
    for m in MODELS.values():
        a, b = sample_params(m, 8), sample_params(m, 8)
        assert a == b and len(a) == 8
    assert resolve("xgboost").name == "boosted_trees" and resolve("sarima").name == "seasonal_arima"
    with pytest.raises(ValueError):
        resolve("oracle")


def test_training_ranks_models_and_serves_requests(spark, folder):
    df, _ = trend_panel(spark, 300, noise=2.0)
    names = ["linear_trend", "decomposable", "seasonal_arima", "boosted_trees"]
    params = {"boosted_trees": {"n_estimators": 4, "max_depth": 3}}
    trained, ranked, failed = train_all(df, K, names, n_trials=0, params=params, model_dir=folder)
    assert not failed
    out = rows_of(ranked, "series_id", "rank")
    assert out["rank"].tolist() == [1, 2, 3, 4] * 2
    assert out[out["model_name"] == "linear_trend"]["test_mape"].max() < 2.0
    assert (out["train_size"] == 240).all() and (out["test_size"] == 60).all()
    fitted = {n: t.fitted for n, t in trained.items()}
    best = ranked.filter("rank = 1").select("series_id", "model_name")
    chosen = request_forecast(fitted, "best", 5, best=best)
    assert chosen.count() == 10
    items, summary = response(request_forecast(fitted, "ensemble", 5), K)
    assert items.count() == 10 and summary.count() == 2
    assert request_forecast(fitted, "all", 5).count() == 40
    with pytest.raises(ValueError):
        request_forecast(fitted, "random_forest", 5)
    with pytest.raises(ValueError):
        search.score(df, K, "linear_trend", 0)


def test_failed_model_is_reported(spark):
    df, _ = trend_panel(spark, 60)
    _, ranked, failed = train_all(df, K, ["linear_trend", "nonesuch"], train_on_full_data=False)
    assert list(failed) == ["nonesuch"] and ranked.count() == 2


def test_ranking_of_all_models_fails_with_any_of_them(spark, monkeypatch):
    """A model whose training breaks must not be left out of a ranking that says it has all models."""
    df, _ = trend_panel(spark, 60)
    train_model = training.train_model

    def breaking(panel, keys, name, *args, **options):
        if name != "linear_trend":
            raise OSError(f"{name}: no space left on device")
        return train_model(panel, keys, name, *args, **options)

    monkeypatch.setattr(training, "train_model", breaking)
    monkeypatch.setattr(queries, "sales", lambda spark, base: df.withColumnRenamed("series_id", "c_mktsegment"))
    with pytest.raises(RuntimeError, match="could not be trained") as caught:
        queries.ranked_backtest(spark, "").count()
    assert isinstance(caught.value.__cause__, OSError)
    with pytest.warns(RuntimeWarning, match="random_forest"):
        _, ranked, failed = train_all(df, K, ["linear_trend", "random_forest"], train_on_full_data=False)
    assert list(failed) == ["random_forest"] and ranked.count() == 2


def test_single_series_without_keys(spark):
    df, _ = trend_panel(spark, 150, keys=("a",))
    one = df.drop("series_id")
    for name in ("linear_trend", "decomposable", "seasonal_arima"):
        got = rows_of(resolve(name).forecast(resolve(name).fit(one, []), 3), "date")
        assert len(got) == 3, name


def test_kept_matrix_has_partitions_by_its_rows_and_not_by_the_session(spark):
    """Every level of a tree runs over all partitions: a session of many must not make the fit of a small panel longer."""
    df, _ = trend_panel(spark, 60, noise=5.0)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    made = []
    try:
        for session in (40, 90):
            spark.conf.set("spark.sql.shuffle.partitions", session)
            rows = trees.assemble(trees.lag_matrix(df, K), "daily_sales")
            kept = trees.keep(rows, K)
            assert kept.rdd.getNumPartitions() == trees.FIT_PARTITIONS
            made.append([[(*[r[k] for k in K], r["date"]) for r in part] for part in kept.rdd.glom().collect()])
            kept.unpersist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert made[0] == made[1] and all(part == sorted(part) for part in made[0]) and sum(map(len, made[0])) == rows.count()
