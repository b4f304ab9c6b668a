import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mixloom.session import CHECKPOINT_DIR, build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
    })
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get(CHECKPOINT_DIR, None):
        session.conf.set(CHECKPOINT_DIR, tempfile.mkdtemp(prefix="mixloom-tests-"))
    yield session
    session.stop()


@pytest.fixture
def texts(spark):
    """The ``text`` column of a table, in the order of a key."""
    def read(df, key="id"):
        return [r["text"] for r in df.orderBy(key).collect()]
    return read
