import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tracelake.operators import ordered  # noqa: E402
from tracelake.plans.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", "tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(params=["plain", "sliced"])
def layout(request, spark, monkeypatch):
    """Run a test with ordinary keys and again with every longer key cut into slices."""
    if request.param == "sliced":
        monkeypatch.setattr(ordered, "SAMPLES_PER_SLICE", 2)
        spark.conf.set(ordered.SLICE_ROWS_CONF, "4")
    yield request.param
    spark.conf.unset(ordered.SLICE_ROWS_CONF)
