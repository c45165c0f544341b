"""Train, tune, test, refit, rank and store every model over the whole panel."""

from __future__ import annotations

import json
import time
import uuid
import warnings
from collections.abc import Callable
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkite.config import DEFAULT, PanelConfig
from panelkite.functions.keys import join_series
from panelkite.models import linear, trees
from panelkite.models.base import Fitted
from panelkite.models.registry import MODELS, resolve
from panelkite.models.search import best_overall, best_params, score
from panelkite.operators.metrics import align, rank_models, trainer_metrics
from panelkite.operators.splits import simple_split, split_info
from panelkite.session import written
from panelkite.sources.store import ResultsStore


@dataclass
class Trained:
    """What one model's training leaves behind: the model to forecast with, and one run row per series."""

    fitted: Fitted
    run_id: str
    runs: DataFrame


def train_model(
    df: DataFrame,
    keys: list[str],
    name: str,
    n_trials: int = 0,
    test_size: float = 0.2,
    train_on_full_data: bool = True,
    params: dict[str, Any] | None = None,
    curve: bool = False,
    model_dir: str | None = None,
    cfg: PanelConfig = DEFAULT,
) -> Trained:
    """Tune inside the training rows, score on untouched test rows, then refit on everything.

    Models fitted per series take the best candidate of each series; the tree models, which share one fit over
    the panel, take the best one over all series.

    Predictions meet actuals on (keys, date), so gaps in the calendar do not shift them.
    """
    if not 0.1 <= test_size <= 0.4:
        raise ValueError("test_size must lie between 0.1 and 0.4")
    started = time.time()
    spec, run_id = resolve(name), f"{name}_{uuid.uuid4().hex[:12]}"
    split = simple_split(df, keys, test_size=test_size, cfg=cfg)
    train, test = (split.filter(F.col("role") == r).drop("fold", "role") for r in ("train", "test"))
    chosen = dict(params or {})
    is_global = spec.name in (trees.BOOSTED, trees.FOREST)
    tuned: dict[str, Any] = {}
    if n_trials:
        scores, candidates = score(train, keys, name, n_trials, cfg=cfg)
        if is_global or not keys:
            chosen = best_overall(scores, candidates) | chosen
        else:
            full = [spec.defaults | c | chosen for c in candidates]
            tuned = {"per_series": written(best_params(scores, keys, full).select(*keys, "params"), "tuned")}
    extra = {"curve": curve} if is_global else {}
    steps = [
        lambda: _stored(spec.fit(train, keys, params=chosen, cfg=cfg, **extra, **tuned)),
        lambda: _horizon(split, keys, cfg),
    ]
    if train_on_full_data:
        steps.append(lambda: _stored(spec.fit(df, keys, params=chosen, cfg=cfg, **tuned)))
    # None needs another's result. Tree fits each keep a matrix and fill the cluster, so they go one after another.
    fitted, days, *refit = [step() for step in steps] if is_global else _side_by_side(df.sparkSession, steps)
    ahead = spec.forecast(fitted, days, include_ci=False, limit=None)
    actual = test.select(*keys, F.col(cfg.date_col).alias("date"), F.col(cfg.target_col).alias("actual"))
    tested = _prefixed(trainer_metrics(align(actual, ahead, keys), keys), keys, "test")
    learned = _prefixed(_train_metrics(train, fitted, cfg), keys, "train")
    if train_on_full_data:
        final = refit[0]
        final.importances = final.importances or fitted.importances
        final.curve = fitted.curve
    else:
        final = fitted
    path = None
    if model_dir:
        path = f"{model_dir}/{spec.name}"
        final.save(path)
    info = split_info(split, keys, cfg).drop("fold")
    runs = join_series(join_series(info, tested, keys), learned, keys)
    used = F.lit(json.dumps(spec.defaults | chosen))
    if "per_series" in tuned:
        runs = join_series(runs, tuned["per_series"], keys)
        used = F.coalesce("params", used)
    runs = runs.withColumns({
        "run_id": F.lit(run_id),
        "model_name": F.lit(spec.name),
        "best_params": used,
        "model_path": F.lit(path).cast("string"),
    })
    runs = written(runs.drop("params"), "runs").withColumn("training_time", F.lit(time.time() - started))
    return Trained(final, run_id, runs)


def _side_by_side(spark: SparkSession, steps: list[Callable[[], Any]]) -> list[Any]:
    with ThreadPool(len(steps)) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda step: step()), steps, chunksize=1)


def _horizon(split: DataFrame, keys: list[str], cfg: PanelConfig) -> int:
    """Days from the end of training to the last test date, at most over all series."""
    last = lambda role: F.max(F.when(F.col("role") == role, F.col(cfg.date_col)))
    gaps = split.groupBy(*keys).agg(F.datediff(last("test"), last("train")).alias("gap"))
    return max(int(gaps.agg(F.max("gap")).first()[0] or 1), 1)


def _stored(fitted: Fitted) -> Fitted:
    """Keep the state in the shared folder, so that scoring and forecasting do not fit again."""
    if fitted.nodes is None:
        fitted.series = written(fitted.series, fitted.model)
    return fitted


def _train_metrics(train: DataFrame, fitted: Fitted, cfg: PanelConfig) -> DataFrame:
    """In-sample error: stored with the state where the kernel computed it, else from fitted values."""
    keys = fitted.keys
    if fitted.model == linear.NAME:
        return trainer_metrics(linear.in_sample(train, fitted, cfg), keys)
    if fitted.model in (trees.BOOSTED, trees.FOREST):
        return trainer_metrics(trees.in_sample(train, fitted, cfg), keys)
    return fitted.series.select(*keys, *[F.col(f"train_{m}").alias(m) for m in ("mape", "mae", "rmse")])


def _prefixed(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return df.select(*keys, *[F.col(m).alias(f"{prefix}_{m}") for m in ("mape", "mae", "rmse")])


def train_all(
    df: DataFrame,
    keys: list[str],
    models: list[str] | None = None,
    store: ResultsStore | None = None,
    n_trials: int = 0,
    test_size: float = 0.2,
    train_on_full_data: bool = True,
    params: dict[str, dict[str, Any]] | None = None,
    model_dir: str | None = None,
    cfg: PanelConfig = DEFAULT,
    needs_all: bool = False,
) -> tuple[dict[str, Trained], DataFrame, dict[str, str]]:
    """Train the models one after another, each distributed, and rank them per series by test error.

    The panel is written once and every fit reads the copy. Returns the trained models, the ranked
    comparison, and the message of every model that failed; a warning names those that the comparison
    lacks. With ``needs_all`` the first failure ends the training, and nothing is ranked or stored.
    """
    df = written(df, "panel")
    out: dict[str, Trained] = {}
    failed: dict[str, str] = {}
    for name in models or list(MODELS):
        try:
            out[name] = train_model(
                df, keys, name, n_trials, test_size, train_on_full_data, (params or {}).get(name),
                model_dir=model_dir, cfg=cfg)
        except Exception as error:  # noqa: BLE001 - one model's failure must not stop the others
            if needs_all:
                raise RuntimeError(f"{name} could not be trained, so the models cannot be ranked") from error
            failed[name] = f"{type(error).__name__}: {str(error)[:300]}"
    if not out:
        raise RuntimeError(f"no model could be trained: {failed}")
    if failed:
        warnings.warn(f"the comparison lacks models that could not be trained: {failed}", RuntimeWarning, stacklevel=2)
    runs = None
    for t in out.values():
        runs = t.runs if runs is None else runs.unionByName(t.runs)
    ranked = rank_models(runs, keys)
    if store is not None:
        store.save_runs(runs)
        store.save_comparison(uuid.uuid4().hex[:12], runs)
        for t in out.values():
            if t.fitted.importances is not None:
                store.save_importance(t.run_id, t.fitted.model, t.fitted.importances)
            if t.fitted.curve is not None:
                store.save_learning_curve(t.run_id, t.fitted.model, t.fitted.curve)
    return out, ranked, failed
