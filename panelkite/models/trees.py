"""Boosted trees and random forests over the whole panel, and their recursive forecast.

One global model is fitted by ``pyspark.ml`` on the lag features of all series, so training is spread
over the rows. For forecasting, the trees become plain node arrays; each series keeps its last 28
values, and one Arrow pass rolls every series of a batch forward through the whole horizon at once.
"""

from __future__ import annotations

from math import ceil
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from panelkite.config import DEFAULT, PanelConfig
from panelkite.functions import windows as win
from panelkite.functions.keys import join_series, series_window, whole_series
from panelkite.models.base import Fitted, check_horizon, finish, points, robust_sigma
from panelkite.models.decomposable import key_fields
from panelkite.session import new_path

BOOSTED, FOREST = "boosted_trees", "random_forest"
# Default parameters, lags, windows and feature names.
DEFAULTS = {
    BOOSTED: {
        "n_estimators": 100, "max_depth": 5, "learning_rate": 0.1, "min_child_weight": 1,
        "subsample": 0.8, "colsample_bytree": 0.8, "early_stopping": True, "patience": 20, "seed": 42,
    },
    FOREST: {
        "n_estimators": 100, "max_depth": 10, "min_samples_split": 5, "min_samples_leaf": 2, "max_features": "sqrt",
        "subsample": 1.0, "seed": 42,
    },
}
LAGS, WINDOWS = (1, 7, 14, 28), (7, 14)
HISTORY = max(LAGS)
FEATURES = (
    [f"lag_{k}" for k in LAGS]
    + [f"rolling_mean_{n}" for n in WINDOWS]
    + [f"rolling_std_{n}" for n in WINDOWS]
    + ["day_of_week", "month", "day_of_year", "day_num"]
)
# Forest sizes at which the learning curve is read.
CURVE_SIZES = (10, 25, 50, 75, 100, 150, 200)
HOLDOUT = 0.2
# Partitions of a kept matrix follow its rows from this number of partitions on.
FIT_ROWS, FIT_PARTITIONS = 20_000, 16


def lag_matrix(df: DataFrame, keys: list[str], cfg: PanelConfig = DEFAULT) -> DataFrame:
    """``keys, date, target`` and the twelve model features; the first 28 rows of a series have NULLs."""
    w = series_window(keys, cfg.date_col)
    y, d = F.col(cfg.target_col).cast("double"), F.col(cfg.date_col)
    exprs = {f"lag_{k}": win.lag(y, k, w) for k in LAGS}
    exprs |= {f"rolling_mean_{n}": win.strict_rolling(y, "mean", n, w) for n in WINDOWS}
    exprs |= {f"rolling_std_{n}": win.strict_rolling(y, "std", n, w) for n in WINDOWS}
    exprs |= {
        "day_of_week": F.weekday(d), "month": F.month(d), "day_of_year": F.dayofyear(d), "day_num": win.position(w),
    }
    return df.filter(y.isNotNull()).select(
        *keys, d.alias("date"), y.alias(cfg.target_col),
        *[exprs[f].cast("double").alias(f) for f in FEATURES],
        F.count(F.lit(1)).over(whole_series(keys, cfg.date_col)).alias("n_train"),
    )


def assemble(matrix: DataFrame, target: str) -> DataFrame:
    """Rows complete in features and target, with the vector column and an honest hold-out flag.

    The hold-out is the last fifth of each series by position, and is not trained on.
    """
    complete = matrix.dropna(subset=[*FEATURES, target])
    held = F.col("day_num") >= F.floor(F.col("n_train") * (1 - HOLDOUT))
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(
        complete.withColumn("is_holdout", held)
    )


def keep(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The assembled rows, kept for the fits in as many partitions as they fill, one series in one, in order of date.

    Every level of every tree is a job over all partitions, so empty ones of the session's shuffle cost more than the rows. A session
    of few partitions keeps its own. Subsamples are drawn by partition, so the number must not hang on the cluster.
    """
    kept = rows.persist(StorageLevel.MEMORY_AND_DISK)
    session = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not keys or session <= FIT_PARTITIONS:
        return kept
    try:
        parts = min(session, max(FIT_PARTITIONS, ceil(kept.count() / FIT_ROWS)))
        packed = kept.repartition(parts, *keys).sortWithinPartitions(*keys, "date").persist(StorageLevel.MEMORY_AND_DISK)
        packed.count()
    finally:
        kept.unpersist()
    return packed


def _estimator(model: str, p: dict[str, Any], target: str):
    if model == BOOSTED:
        return GBTRegressor(
            labelCol=target, featuresCol="features", maxIter=int(p["n_estimators"]), maxDepth=int(p["max_depth"]),
            stepSize=float(p["learning_rate"]), minInstancesPerNode=int(p["min_child_weight"]),
            subsamplingRate=float(p["subsample"]), featureSubsetStrategy=str(float(p["colsample_bytree"])),
            seed=int(p["seed"]), cacheNodeIds=True,
        )
    return RandomForestRegressor(
        labelCol=target, featuresCol="features", numTrees=int(p["n_estimators"]), maxDepth=int(p["max_depth"]),
        minInstancesPerNode=int(p["min_samples_leaf"]), featureSubsetStrategy=str(p["max_features"]),
        subsamplingRate=float(p["subsample"]), seed=int(p["seed"]), cacheNodeIds=True,
    )


def best_round(losses: list[float], patience: int) -> int:
    """The round of the least loss, counted from 1, when boosting stops ``patience`` rounds without a lesser one."""
    best, at = float("inf"), 0
    for i, loss in enumerate(losses, 1):
        if loss < best:
            best, at = loss, i
        elif i - at >= patience:
            break
    return at or len(losses)


def fit_rows(rows: DataFrame, model: str, p: dict[str, Any], target: str, curve: bool = False):
    """The model of all assembled rows, the model that never saw the hold-out (None if not needed), and the rounds.

    With early stopping the rounds are those of the least hold-out loss, found with the given patience from the loss of every
    round; without a hold-out row all rounds are fitted.
    """
    stops = model == BOOSTED and p["early_stopping"]
    honest, rounds = None, int(p["n_estimators"])
    if curve or stops:
        honest = _estimator(model, p, target).fit(rows.filter(~F.col("is_holdout")))
    if stops:
        losses = [r["sse"] / r["n"] for r in round_losses(honest, rows.filter("is_holdout"), model, target, p).orderBy("iteration").collect()]
        rounds = best_round(losses, int(p["patience"])) if losses else rounds
    return _estimator(model, p | {"n_estimators": rounds}, target).fit(rows), honest, rounds


def fit(
    df: DataFrame,
    keys: list[str],
    model: str = BOOSTED,
    params: dict[str, Any] | None = None,
    cfg: PanelConfig = DEFAULT,
    curve: bool = False,
) -> Fitted:
    """Fit on all rows with complete features.

    Early stopping and the learning curve use a first fit that never sees the hold-out; the number of
    rounds found there is the number of rounds of the final fit.
    """
    p = DEFAULTS[model] | (params or {})
    target, spark = cfg.target_col, df.sparkSession
    rows = keep(assemble(lag_matrix(df, keys, cfg), target), keys)
    learning = None
    try:
        trained, honest, rounds = fit_rows(rows, model, p, target, curve)
        if curve:
            learning = _curve(honest, rows, model, target, p)
        nodes = node_table(trained, model, p)
        if model == FOREST:  # its nodes may be cut back, so the fitted values come from the node table
            residuals = _fitted_values(rows, nodes, keys, target).withColumn("residual", F.col("actual") - F.col("predicted"))
        else:
            residuals = trained.transform(rows).select(*keys, (F.col(target) - F.col("prediction")).alias("residual"))
        state = join_series(tails(df, keys, cfg), robust_sigma(residuals, keys), keys)
        path = new_path(spark, f"{model}-state")
        state.write.parquet(path)
    finally:
        rows.unpersist()
    scores = [(f, float(s)) for f, s in zip(FEATURES, trained.featureImportances.toArray())]
    importances = spark.createDataFrame(
        [(f, s, i) for i, (f, s) in enumerate(sorted(scores, key=lambda v: (-abs(v[1]), v[0])), 1)],
        "feature_name string, importance_score double, importance_rank int",
    )
    return Fitted(model, keys, p, spark.read.parquet(path), nodes, importances, learning, {"rounds": rounds})


def tails(df: DataFrame, keys: list[str], cfg: PanelConfig) -> DataFrame:
    """One row per series: length, last date and its last 28 values, oldest first.

    A shorter series is continued backwards with its first value, so every series gets a forecast.
    """
    w = series_window(keys, cfg.date_col)
    rows = df.filter(F.col(cfg.target_col).isNotNull()).select(
        *keys, F.col(cfg.date_col).alias("date"), F.col(cfg.target_col).cast("double").alias("y"),
        F.row_number().over(w).alias("i"), F.count(F.lit(1)).over(whole_series(keys, cfg.date_col)).alias("n"),
    )
    recent = rows.filter(F.col("i") > F.col("n") - HISTORY)
    return recent.groupBy(*keys).agg(
        F.first("n").alias("n_train"), F.max("date").alias("last_date"),
        F.transform(F.array_sort(F.collect_list(F.struct("i", "y"))), lambda r: r["y"]).alias("tail"),
    ).withColumn("tail", F.concat(F.array_repeat(F.element_at("tail", 1), F.lit(HISTORY) - F.size("tail")), "tail"))


def node_table(trained, model: str, p: dict[str, Any] | None = None) -> DataFrame:
    """``tree, node, feature, threshold, left, right, value, weight, n_rows`` from the node rows of the saved model.

    A node of fewer than ``min_samples_split`` training rows is a leaf with its own mean. Counts only fall on the way down,
    so all below it goes, and what is above it stays.
    """
    spark = SparkSession.active()
    path = new_path(spark, "trees")
    trained.write().save(path)
    n = F.col("nodeData")
    scale = 1.0 / trained.getNumTrees if model == FOREST else 1.0
    weights = F.array(*[F.lit(float(w) * scale) for w in trained.treeWeights])
    leaf = (n["leftChild"] < 0) | (n["rawCount"] < int((p or {}).get("min_samples_split", 2)))
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        n["id"].alias("node"),
        F.when(leaf, F.lit(-1)).otherwise(n["split"]["featureIndex"]).alias("feature"),
        F.when(leaf, F.lit(0.0)).otherwise(F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
        F.when(leaf, F.lit(-1)).otherwise(n["leftChild"]).alias("left"),
        F.when(leaf, F.lit(-1)).otherwise(n["rightChild"]).alias("right"),
        n["prediction"].alias("value"),
        F.get(weights, F.col("treeID")).alias("weight"),
        n["rawCount"].cast("long").alias("n_rows"),
    )


def pack_nodes(nodes: DataFrame) -> dict[str, np.ndarray]:
    """Node arrays with absolute child positions, some 30 bytes a node.

    Their size follows the number and depth of the trees, which are parameters of the model.
    """
    table = nodes.drop("n_rows").toArrow()
    raw = {name: table.column(name).to_numpy() for name in table.column_names}
    order = np.lexsort((raw["node"], raw["tree"]))
    node = {name: values[order] for name, values in raw.items()}
    here = np.arange(len(order))
    start = np.flatnonzero(np.diff(node["tree"], prepend=-1))
    base = np.repeat(start, np.diff(np.append(start, len(order))))
    leaf = node["feature"] < 0
    # Leaves point at themselves, so a walk may go on past the end of a short branch.
    return {
        "root": start.astype(np.int32),
        "weight": node["weight"].astype(float)[start],
        "feature": np.where(leaf, 0, node["feature"]).astype(np.int32),
        "threshold": np.where(leaf, np.inf, node["threshold"]),
        "left": np.where(leaf, here, base + node["left"]).astype(np.int32),
        "right": np.where(leaf, here, base + node["right"]).astype(np.int32),
        "value": node["value"].astype(float),
        "leaf": leaf,
    }


def tree_values(forest: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Rows by trees: the leaf value of every tree for every row."""
    at = np.broadcast_to(forest["root"], (len(x), len(forest["root"]))).copy()
    row = np.arange(len(x))[:, None]
    while not forest["leaf"][at].all():
        go_left = x[row, forest["feature"][at]] <= forest["threshold"][at]
        at = np.where(go_left, forest["left"][at], forest["right"][at])
    return forest["value"][at]


def roll_forward(
    forest: dict[str, np.ndarray], tail: np.ndarray, n: np.ndarray, last_day: np.ndarray, steps: int
) -> np.ndarray:
    """Recursive forecast of a batch of series: each prediction, clamped at 0, becomes the newest value."""
    values = np.concatenate([tail, np.zeros((len(tail), steps))], axis=1)
    for h in range(steps):
        end = HISTORY + h
        days = pd.DatetimeIndex(((last_day + h + 1).astype("int64")).astype("datetime64[D]"))
        x = np.column_stack(
            [values[:, end - k] for k in LAGS]
            + [values[:, end - k:end].mean(axis=1) for k in WINDOWS]
            + [values[:, end - k:end].std(axis=1, ddof=1) for k in WINDOWS]
            + [days.dayofweek, days.month, days.dayofyear, n + h]
        )
        values[:, end] = np.maximum(tree_values(forest, x) @ forest["weight"], 0.0)
    return values[:, HISTORY:]


def forecast(
    fitted: Fitted, n_days: int, level: float = 0.95, include_ci: bool = True, limit: int | None = 365
) -> DataFrame:
    check_horizon(n_days, limit)
    keys = fitted.keys
    # One copy an executor, whatever the number of tasks.
    shared = fitted.series.sparkSession.sparkContext.broadcast(pack_nodes(fitted.nodes))
    extra = [T.StructField("last_date", T.DateType()), T.StructField("residual_std", T.DoubleType()),
             T.StructField("v", T.ArrayType(T.DoubleType()))]
    schema = T.StructType(key_fields(fitted.series, keys) + extra)

    def kernel(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            last = pd.to_datetime(pdf["last_date"]).to_numpy().astype("datetime64[D]").astype("int64")
            out = roll_forward(shared.value, np.stack(pdf["tail"].to_list()), pdf["n_train"].to_numpy(float), last, n_days)
            yield pdf[[*keys, "last_date", "residual_std"]].assign(v=list(out))

    path = points(n_days, lambda i, _: {"predicted": F.element_at("v", i)})
    return finish(fitted.series.mapInPandas(kernel, schema), keys, fitted.model, path, level, include_ci)


def in_sample(df: DataFrame, fitted: Fitted, cfg: PanelConfig = DEFAULT) -> DataFrame:
    """``keys, date, actual, predicted``: one-step predictions on rows with complete features."""
    rows = lag_matrix(df, fitted.keys, cfg).dropna(subset=[*FEATURES, cfg.target_col])
    return _fitted_values(rows, fitted.nodes, fitted.keys, cfg.target_col)


def _fitted_values(rows: DataFrame, nodes: DataFrame, keys: list[str], target: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(pack_nodes(nodes))
    schema = T.StructType(
        key_fields(rows, keys) + [T.StructField("date", T.DateType()), T.StructField("actual", T.DoubleType()),
                                  T.StructField("predicted", T.DoubleType())])

    def kernel(batches):
        forest = shared.value
        for pdf in batches:
            p = tree_values(forest, pdf[FEATURES].to_numpy(float)) @ forest["weight"]
            yield pdf[[*keys, "date"]].assign(actual=pdf[target], predicted=p)

    return rows.select(*keys, "date", target, *FEATURES).mapInPandas(kernel, schema)


def round_losses(trained, rows: DataFrame, model: str, target: str, p: dict[str, Any]) -> DataFrame:
    """``iteration, held, sse, n``: squared errors after each boosting round, or at each forest size, in one pass.

    At most one row per round and side; a side without rows has none.
    """
    nodes = node_table(trained, model, p)
    forest = pack_nodes(nodes)
    total = len(forest["root"])
    sizes = list(range(1, total + 1)) if model == BOOSTED else sorted({s for s in CURVE_SIZES if s <= total} | {total})
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def kernel(batches):
        trees, at = shared.value, np.array(sizes)
        for pdf in batches:
            if not len(pdf):
                continue
            x, y = np.stack(pdf["x"].to_list()), pdf["y"].to_numpy(float)
            weights = trees["weight"] if model == BOOSTED else np.ones(total)
            sums = np.cumsum(tree_values(trees, x) * weights, axis=1)[:, at - 1]
            sq = ((sums if model == BOOSTED else sums / at) - y[:, None]) ** 2
            for held in (False, True):
                mask = pdf["held"].to_numpy(bool) == held
                if mask.any():
                    yield pd.DataFrame({"iteration": sizes, "held": held, "sse": sq[mask].sum(axis=0), "n": int(mask.sum())})

    flat = rows.select(vector_to_array("features").alias("x"), F.col(target).alias("y"), F.col("is_holdout").alias("held"))
    sums = flat.mapInPandas(kernel, "iteration int, held boolean, sse double, n long")
    return sums.groupBy("iteration", "held").agg(F.sum("sse").alias("sse"), F.sum("n").alias("n"))


def _curve(trained, rows: DataFrame, model: str, target: str, p: dict[str, Any]) -> DataFrame:
    """``iteration, train_loss, val_loss`` as RMSE: per boosting round, or per forest size from one fit."""
    held = F.col("held")
    rmse = lambda c: F.sqrt(F.try_divide(F.sum(F.when(c, F.col("sse"))), F.sum(F.when(c, F.col("n")))))
    out = round_losses(trained, rows, model, target, p).groupBy("iteration").agg(rmse(~held).alias("train_loss"), rmse(held).alias("val_loss"))
    return rows.sparkSession.createDataFrame(out.orderBy("iteration").collect(), "iteration int, train_loss double, val_loss double")


def curve_verdict(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Overfitting when the gap passes 30 % of the training loss, underfitting above a loss of 1000, else good."""
    by = by or []
    last = curve.groupBy(*by).agg(F.max_by(F.struct("train_loss", "val_loss"), "iteration").alias("l"))
    train, val = F.col("l.train_loss"), F.col("l.val_loss")
    verdict = (
        F.when(val - train > 0.3 * train, "overfitting").when(train > 1000, "underfitting").otherwise("good_fit")
    )
    return last.select(*by, train.alias("train_loss"), val.alias("val_loss"), verdict.alias("verdict"))
