"""Shared session and seeded fixtures: one daily series, a three-series panel, and mutations of them."""

from __future__ import annotations

import os
import sys
import tempfile

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from panelkite.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, partitions=4, app="tests")
    yield session
    session.stop()


def sales_frame(days: int = 100, seed: int = 42, start: str = "2023-01-01") -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    dates = pd.date_range(start, periods=days)
    return pd.DataFrame({
        "date": dates.date,
        "daily_sales": rng.integers(10_000, 50_000, days).astype(float),
        "product_category": "Electronics",
        "marketing_spend": rng.integers(2_000, 10_000, days).astype(float),
        "day_of_week": dates.day_name(),
        "is_holiday": rng.choice([0, 1], days, p=[0.95, 0.05]),
    })


DDL = ("date date, daily_sales double, product_category string, marketing_spend double, "
       "day_of_week string, is_holiday int")


def to_spark(spark, pdf: pd.DataFrame, keyed: bool = False):
    clean = pdf.astype(object).where(pd.notna(pdf), None)
    ddl = ("series_id string, " if keyed else "") + DDL
    return spark.createDataFrame([tuple(r) for r in clean.itertuples(index=False)], ddl)


@pytest.fixture(scope="session")
def one(spark):
    return to_spark(spark, sales_frame()).cache()


@pytest.fixture(scope="session")
def panel_pdf():
    parts = [sales_frame(80 + 10 * i, seed=i).assign(series_id=f"s{i}") for i in range(3)]
    pdf = pd.concat(parts, ignore_index=True)
    return pdf[["series_id", *[c for c in pdf.columns if c != "series_id"]]]


@pytest.fixture(scope="session")
def panel(spark, panel_pdf):
    return to_spark(spark, panel_pdf, keyed=True).repartition(5).cache()


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="run-")


def rows_of(df, *order):
    return df.orderBy(*order).toPandas() if order else df.toPandas()
