"""Every registered query against its SQL on DuckDB, on the smallest driver tables."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

ROOT = os.path.join(os.path.dirname(os.path.abspath(__file__)), "..")
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as contract  # noqa: E402
import compare  # noqa: E402

BASE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="driver tables absent")


@pytest.fixture(scope="module")
def con():
    return compare.connect(BASE)


def test_entry_runs(spark):
    assert contract.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query_matches_sql(spark, con, name):
    ok, note = compare.compare(spark, con, BASE, name)
    assert ok, note


@pytest.mark.skipif(not os.path.isdir(BASE), reason="driver tables absent")
def test_kernels_run_where_the_package_is_not_installed(tmp_path):
    """Workers started outside the repository cannot import it; the kernels must travel whole."""
    code = (
        f"import sys; sys.path.insert(0, {ROOT!r})\n"
        "from panelkite.session import local_session\n"
        "spark = local_session(4, partitions=4)\n"
        "import __spark_entry__ as c\n"
        "for n in ('decomposable_forecast', 'seasonal_arima_forecast', 'linear_weekday_forecast', 'trend_significance',\n"
        "          'random_forest_forecast', 'arima_search'):\n"
        f"    assert len(c.queries()[n](spark, {BASE!r}).toPandas()) > 0, n\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
