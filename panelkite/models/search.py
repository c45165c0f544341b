"""Parameter search on walk-forward folds inside the training rows, never on the test rows.

Every candidate is fitted on each expanding window and scored on the block after it; its score is the mean over the folds.
"""

from __future__ import annotations

import json
from functools import reduce
from math import ceil
from multiprocessing.pool import ThreadPool
from typing import Any

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkite.config import DEFAULT, PanelConfig
from panelkite.models import arima, decomposable, linear, trees
from panelkite.models.base import Fitted
from panelkite.models.decomposable import key_fields, panel_rows
from panelkite.models.registry import resolve, sample_params
from panelkite.operators.metrics import align, regression_metrics
from panelkite.operators.splits import walk_forward_split
from panelkite.session import written

N_FOLDS = 3
CONCURRENT_FITS = 4


def horizon(train: DataFrame, test: DataFrame, keys: list[str], cfg: PanelConfig = DEFAULT) -> int:
    """Days from the end of training to the last test date, at most over all series."""
    d = cfg.date_col
    ends = train.groupBy(*keys).agg(F.max(d).alias("a"))
    last = test.groupBy(*keys).agg(F.max(d).alias("b"))
    if keys:
        gap = ends.join(last, keys).agg(F.max(F.datediff("b", "a")).alias("h"))
    else:
        gap = ends.withColumn("b", last.scalar()).agg(F.max(F.datediff("b", "a")).alias("h"))
    return max(int(gap.first()["h"] or 1), 1)


def score(
    df: DataFrame, keys: list[str], model: str, n_trials: int = 10, seed: int = 42, cfg: PanelConfig = DEFAULT, n_folds: int = N_FOLDS
) -> tuple[DataFrame, list[dict[str, Any]]]:
    """``keys, trial, mape`` for every candidate, and the candidates.

    The folds are those of ``walk_forward_split`` over the rows that have a target. The score is the mean over the folds with
    an actual other than 0, and NULL if a fit fails in one of them or the series is too short for a fold.
    """
    if not 1 <= n_trials <= 100:
        raise ValueError("n_trials must lie between 1 and 100")
    if n_folds < 1:
        raise ValueError("n_folds must be at least 1")
    spec = resolve(model)
    candidates = sample_params(spec, n_trials, seed)
    if spec.name in (decomposable.NAME, arima.NAME):
        return _score_kernel(df, keys, spec.name, candidates, cfg, n_folds), candidates
    if spec.name == linear.NAME:
        folds = linear.score_candidates(df, keys, candidates, n_folds, cfg)
        scores = _complete(folds.groupBy(*keys, "trial").agg(F.avg("mape").alias("mape")), df, keys, candidates)
        # Written, as sums that are taken again may differ in the last digits.
        return written(scores, "scores"), candidates
    return _score_global(df, keys, spec.name, candidates, cfg, n_folds), candidates


def _complete(scores: DataFrame, df: DataFrame, keys: list[str], candidates: list[dict[str, Any]]) -> DataFrame:
    """Every series and trial, with a NULL score for a series without a fold."""
    trials = F.explode(F.sequence(F.lit(0), F.lit(len(candidates) - 1))).alias("trial")
    if not keys:
        every = df.groupBy().agg(F.count("*").alias("__n")).filter("__n > 0").select(trials)
        return every.join(scores, "trial", "left")
    return df.select(*keys).distinct().select(*keys, trials).join(scores, [*keys, "trial"], "left")


def folds_of(n: int, n_folds: int) -> list[tuple[int, int]]:
    """Training and test ends of each fold of a series of ``n`` rows, as in ``walk_forward_split``."""
    least = n // 2
    size = (n - least) // n_folds
    return [(least + f * size, min(least + (f + 1) * size, n)) for f in range(n_folds)] if size else []


def _score_kernel(
    df: DataFrame, keys: list[str], name: str, candidates: list[dict[str, Any]], cfg: PanelConfig, n_folds: int
) -> DataFrame:
    """A series is one row of arrays. Few series are dealt in several parts of the trials each, so that a search of one
    series uses all cores; with many, a series travels once."""
    errors = {decomposable.NAME: decomposable.candidate_errors, arima.NAME: arima.candidate_errors}[name]
    schema = T.StructType(key_fields(df, keys) + [T.StructField("trial", T.IntegerType()), T.StructField("mape", T.DoubleType())])
    columns = ("day", "y", "holiday")
    packed = panel_rows(df, keys, cfg).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("h"))
    pick = lambda c: F.transform("h", lambda r: r[c]).alias(f"__{c}")
    packed = written(packed.select(*keys, *[pick(c) for c in columns]), "histories")
    n, cores = packed.count(), df.sparkSession.sparkContext.defaultParallelism
    parts = min(len(candidates), max(1, ceil(2 * cores / max(n, 1))))
    dealt = packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("__part")).repartition(
        max(1, min(n * parts, max(2 * cores, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))))

    def scored(series: tuple[np.ndarray, ...], own: list[dict[str, Any]]) -> list[float | None]:
        day, y, _ = series
        folds = [(a, b) for a, b in folds_of(len(day), n_folds) if a >= 2 and (y[a:b] != 0).any()]
        by_fold = [errors(tuple(v[:a] for v in series), tuple(v[a:b] for v in series), own) for a, b in folds]
        return [None if not folds or None in row else float(np.mean(row)) for row in zip(*by_fold)] if folds else [None] * len(own)

    def kernel(batches):
        for pdf in batches:
            for _, r in pdf.iterrows():
                trials = list(range(int(r["__part"]), len(candidates), parts))
                values = scored(tuple(np.asarray(r[f"__{c}"], float) for c in columns), [candidates[t] for t in trials])
                out = pd.DataFrame({"trial": trials, "mape": pd.Series(values, dtype=float)})
                for k in keys:
                    out[k] = r[k]
                yield out[[*keys, "trial", "mape"]]

    made = dealt.mapInPandas(kernel, schema)
    return made.withColumn("mape", F.when(~F.isnan("mape"), F.col("mape")))


def _score_global(
    df: DataFrame, keys: list[str], name: str, candidates: list[dict[str, Any]], cfg: PanelConfig, n_folds: int
) -> DataFrame:
    """Tree models share one fit over the panel. The lag matrix of all folds is made once and kept; the fits of trials and
    folds, each distributed, run a few at a time over it."""
    spec, spark = resolve(name), df.sparkSession
    by_fold = [*keys, "fold"]
    split = written(walk_forward_split(df.filter(F.col(cfg.target_col).isNotNull()), keys, n_folds, cfg=cfg), "folds")
    train, valid = (split.filter(F.col("role") == r).drop("role") for r in ("train", "test"))
    days = horizon(train, valid, by_fold, cfg)
    actual = valid.select(*by_fold, F.col(cfg.date_col).alias("date"), F.col(cfg.target_col).alias("actual"))
    tails = written(trees.tails(train, by_fold, cfg), "tails")
    matrix = trees.keep(trees.assemble(trees.lag_matrix(train, by_fold, cfg), cfg.target_col), by_fold)
    failures: list[Exception] = []

    def one(trial: int, fold: int) -> DataFrame:
        here = F.col("fold") == fold
        try:
            params = spec.defaults | candidates[trial]
            trained, _, _ = trees.fit_rows(matrix.filter(here), spec.name, params, cfg.target_col)
            state = tails.filter(here).drop("fold").withColumn("residual_std", F.lit(None).cast("double"))
            fitted = Fitted(spec.name, keys, params, state, trees.node_table(trained, spec.name, params))
            ahead = spec.forecast(fitted, days, include_ci=False, limit=None)
            made = regression_metrics(align(actual.filter(here).drop("fold"), ahead, keys), keys).select(*keys, "mape", F.lit(False).alias("failed"))
            return written(made.withColumns({"trial": F.lit(trial), "fold": F.lit(fold)}), "scores")
        except Exception as error:  # noqa: BLE001 - a candidate that cannot be fitted ranks last
            failures.append(error)
            lost = actual.filter(here).select(*keys).distinct() if keys else actual.filter(here).select(F.lit(1).alias("x")).limit(1).drop("x")
            return lost.select(*keys, F.lit(None).cast("double").alias("mape"), F.lit(True).alias("failed"), F.lit(trial).alias("trial"),
                               F.lit(fold).alias("fold"))

    jobs = [(t, f) for t in range(len(candidates)) for f in range(n_folds)]
    try:
        with ThreadPool(min(CONCURRENT_FITS, len(jobs))) as pool:
            parts = pool.map(inheritable_thread_target(spark)(lambda job: one(*job)), jobs, chunksize=1)
    finally:
        matrix.unpersist()
    if len(failures) == len(jobs):
        raise RuntimeError(f"no candidate of {name} could be fitted") from failures[-1]
    folds = reduce(DataFrame.unionByName, parts)
    mean = folds.groupBy(*keys, "trial").agg(F.when(~F.bool_or("failed"), F.avg("mape")).alias("mape"))
    return _complete(mean, df, keys, candidates)


def best_params(scores: DataFrame, keys: list[str], candidates: list[dict[str, Any]]) -> DataFrame:
    """``keys, trial, mape, params`` of the best candidate per series; failures rank last."""
    best = scores.groupBy(*keys).agg(
        F.min_by(F.struct("trial", "mape"), F.struct(F.coalesce("mape", F.lit(float("inf"))), "trial")).alias("b")
    )
    texts = F.array(*[F.lit(json.dumps(c)) for c in candidates])
    return best.select(*keys, "b.trial", "b.mape", F.get(texts, F.col("b.trial")).alias("params"))


def best_overall(scores: DataFrame, candidates: list[dict[str, Any]]) -> dict[str, Any]:
    """The candidate with the smallest mean error over all series."""
    row = (
        scores.groupBy("trial").agg(F.avg("mape").alias("m"))
        .orderBy(F.asc_nulls_last("m"), "trial").first()
    )
    return candidates[row["trial"]] if row else candidates[0]
