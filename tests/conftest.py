import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rowtrace.session import build_session, release_caches  # noqa: E402
from rowtrace.sources.tables import Tables  # noqa: E402

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = build_session("8", 8, "tests")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def fresh_caches():
    yield
    release_caches()


@pytest.fixture(scope="session")
def small(spark):
    return Tables(spark, SMALL)


@pytest.fixture(scope="session")
def medium(spark):
    return Tables(spark, MEDIUM)


def rows(df):
    """Rows as a sorted list of tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
