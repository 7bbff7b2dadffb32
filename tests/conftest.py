import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from tempograin import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session.build_session("tests", master="local[8]", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def chunked(spark):
    """Force every ordered computation through the chunked path."""
    def use(rows: int):
        spark.conf.set(session.ROWS_PER_CHUNK_KEY, str(rows))
    yield use
    spark.conf.unset(session.ROWS_PER_CHUNK_KEY)
