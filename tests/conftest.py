"""One Spark session for all tests, and small tables to check rules by hand."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from sheetlens import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("sheetlens-tests", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture
def messy(spark):
    rows = [("A", 10.0), ("B", None), ("A", 10.0), (None, 30.0), ("B", 40.0), ("A", 10.0), ("A", 10.0)]
    return spark.createDataFrame(rows, "Category string, Value double").coalesce(1)


@pytest.fixture(scope="session")
def sales(spark):
    """400 orders: sales follow spending, a few are three times as large."""
    from sheetlens.sources.samples import sample_table

    return sample_table(spark, "sales").cache()
