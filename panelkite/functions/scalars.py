"""Scalar helpers, and the two special functions Spark SQL lacks (normal quantile, Student-t tail)."""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# The search-parameter prefixes that name a model.
PARAM_PREFIXES = ("lt_", "xgb_", "rf_", "prophet_", "sarima_")

# Fixed value: robust-sigma factor for the median absolute deviation.
MAD_TO_SIGMA = 1.4826


def non_negative(x: Column) -> Column:
    """max(x, 0); NULL stays NULL (a bare ``greatest`` would turn it into 0)."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def money(x: Column) -> Column:
    return F.round(x, 2)


def importance(x: Column) -> Column:
    return F.round(x, 4)


def contains_text(columns: list[str], term: str) -> Column:
    """Case-insensitive substring search over the text of a row."""
    text = F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])
    return F.contains(F.lower(text), F.lit(term.lower()))


def strip_param_prefix(name: Column) -> Column:
    return F.regexp_replace(name, "^(" + "|".join(PARAM_PREFIXES) + ")", "")


def strip_param_prefixes(params: Column) -> Column:
    """Map form of :func:`strip_param_prefix`."""
    return F.transform_keys(params, lambda k, _: strip_param_prefix(k))


def z_value(level: float) -> float:
    """Two-sided normal quantile of a confidence level."""
    if not 0.0 < level < 1.0:
        raise ValueError("level must lie strictly between 0 and 1")
    return NormalDist().inv_cdf(0.5 + level / 2.0)


# Wichura's algorithm AS 241 (1988) for the normal quantile, lowest power first:
# numerator and denominator of the central region, the near tail and the far tail.
AS241 = {
    "central": (
        (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
         4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
        (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
         2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
    ),
    "near": (
        (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
         1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
        (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
         1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
    ),
    "far": (
        (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
         2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
        (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
         7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
    ),
}


def _rational(region: str, r: Column) -> Column:
    num, den = (reduce(lambda acc, c: acc * r + F.lit(c), reversed(cs), F.lit(0.0)) for cs in AS241[region])
    return num / den


def inverse_normal(p: Column) -> Column:
    """Normal quantile of a probability as a JVM expression; NULL outside (0, 1)."""
    q = p - 0.5
    central = q * _rational("central", F.lit(0.180625) - q * q)
    r = F.sqrt(-F.ln(F.least(p, 1.0 - p)))
    tail = F.when(r <= 5.0, _rational("near", r - 1.6)).otherwise(_rational("far", r - 5.0))
    value = F.when(F.abs(q) <= 0.425, central).when(q < 0, -tail).otherwise(tail)
    return F.when((p > 0.0) & (p < 1.0), value)


def incomplete_beta(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by the modified Lentz continued fraction, vectorised."""
    a, x = np.asarray(a, float), np.asarray(x, float)
    swap = x >= (a + 1.0) / (a + b + 2.0)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - x, x)
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
        tiny = 1e-300
        c = np.ones_like(z)
        d = 1.0 - (p + q) * z / (p + 1.0)
        d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 300):
            for num in (
                m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
                -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1)),
            ):
                d = 1.0 + num * d
                d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1.0 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                step = d * c
                h = h * step
            if np.all(np.abs(step - 1.0) < 1e-15):
                break
        value = np.where(z <= 0.0, 0.0, front * h)
    return np.where(swap, 1.0 - value, value)


@F.pandas_udf(DoubleType())
def t_two_sided_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value of a t statistic; for one row per series, not for the hot path."""
    tv, nu = t.to_numpy(float), df.to_numpy(float)
    ok = np.isfinite(nu) & (nu > 0) & ~np.isnan(tv)
    out = np.full(len(tv), np.nan)
    if ok.any():
        t2 = np.square(np.minimum(np.abs(tv[ok]), 1e150))
        out[ok] = incomplete_beta(nu[ok] / 2.0, 0.5, nu[ok] / (nu[ok] + t2))
    return pd.Series(out).where(ok, None)
