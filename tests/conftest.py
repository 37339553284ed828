import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from knowndate.session import local_session

    session = local_session(8, "knowndate-tests")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Build a small frame: rows(schema, [tuples])."""
    return lambda schema, data: spark.createDataFrame(data, schema)
