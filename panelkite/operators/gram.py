"""Pairwise correlations of many columns: blocked products of whole batches instead of one aggregate per pair."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkite.functions.keys import attach

BLOCK = 64
HELD_GROUPS = 8
FAN_IN = 64
# Counts, sums of a where b is known, sums of squares of a where b is known, and sums of a * b.
PARTS = 4


def products(x: np.ndarray) -> np.ndarray:
    """The four sums of every ordered pair of columns over the rows in which both are known; unknown is NaN."""
    known = ~np.isnan(x)
    value, known = np.where(known, x, 0.0), known.astype(float)
    return np.stack([known.T @ known, value.T @ known, (value * value).T @ known, value.T @ value])


def correlations(sums: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Coefficients from the sums of (a, b) and those of (b, a); NaN without spread on either side."""
    n, s, ss, cross = sums
    _, r, rr, _ = other
    with np.errstate(divide="ignore", invalid="ignore"):
        va, vb = ss - s * s / n, rr - r * r / n
        flat = (va <= 1e-14 * ss) | (vb <= 1e-14 * rr) | (n < 2)
        return np.where(flat, np.nan, np.clip((cross - s * r / n) / np.sqrt(va * vb), -1.0, 1.0))


def wide_correlations(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``keys, column_a, column_b, correlation`` for the lower triangle over complete pairs; NULL without spread.

    Values are taken from the middle of each column's range, so that sums do not cancel. A task holds the sums of a few keys,
    in blocks of columns; partial sums are added in two steps, so no task adds those of all tasks. The plan grows with the
    columns and not with their pairs. NaN counts as unknown. Keys may be NULL.
    """
    names, p = list(columns), len(columns)
    typed = [F.col(c).cast("double") for c in names]
    clean = df.select(*keys, *[F.when(~F.isnan(v), v).alias(f"c{i}") for i, v in enumerate(typed)])
    middle = clean.agg(F.array(*[F.min(f"c{i}") + (F.max(f"c{i}") - F.min(f"c{i}")) / 2 for i in range(p)]).alias("middle"))
    rows = attach(clean, middle, []).select(
        *keys, F.array(*[F.col(f"c{i}") - F.col("middle")[i] for i in range(p)]).alias("x"))
    rows = rows.withColumn("bucket", F.pmod(F.spark_partition_id(), F.lit(FAN_IN)))
    key_fields = [df.schema[k] for k in keys]
    partial = T.StructType([*key_fields, T.StructField("bucket", T.IntegerType()), T.StructField("block", T.IntegerType()),
                            T.StructField("sums", T.BinaryType())])
    blocks = [(b, min(b + BLOCK, p)) for b in range(0, p, BLOCK)]

    def summed(batches):
        held: dict[tuple, np.ndarray] = {}

        def flushed():
            rows = [(*key, b // BLOCK, sums[:, b:e].tobytes()) for key, sums in held.items() for b, e in blocks]
            held.clear()
            return pd.DataFrame(rows, columns=partial.names)

        for pdf in batches:
            for key, part in pdf.groupby([*keys, "bucket"], dropna=False, sort=False):
                key = tuple(None if isinstance(k, float) and np.isnan(k) else k for k in key)
                x = np.array([np.asarray(v, float) for v in part["x"]])
                held[key] = held[key] + products(x) if key in held else products(x)
                if len(held) > HELD_GROUPS:
                    yield flushed()
        if held:
            yield flushed()

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b) for b in pdf["sums"])
        return pdf.iloc[:1].assign(sums=total.tobytes())[partial.names]

    def finished(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        sums = np.concatenate([np.frombuffer(s).reshape(PARTS, -1, p) for s in pdf["sums"]], axis=1)
        found = correlations(sums, sums.transpose(0, 2, 1))
        a, b = np.tril_indices(p, -1)
        out = pd.DataFrame({"column_a": [names[i] for i in a], "column_b": [names[i] for i in b], "correlation": found[a, b]})
        for k in keys:
            out[k] = [pdf[k].iloc[0]] * len(out)
        return out[[*keys, "column_a", "column_b", "correlation"]]

    two_steps = rows.mapInPandas(summed, partial).groupBy(*keys, "bucket", "block").applyInPandas(added, partial)
    total = two_steps.groupBy(*keys, "block").applyInPandas(added, partial)
    result = T.StructType([*key_fields, T.StructField("column_a", T.StringType()), T.StructField("column_b", T.StringType()),
                           T.StructField("correlation", T.DoubleType())])
    made = total.groupBy(*keys).applyInPandas(finished, result)
    return made.withColumn("correlation", F.when(~F.isnan("correlation"), F.col("correlation")))
