import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from agestrata.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8, partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    """Rows to a DataFrame with one parse of ``a int, b string``."""

    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make
