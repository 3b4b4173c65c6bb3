import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from feira import CleanTables, build_session  # noqa: E402
from feira.sources.sample import sample_tables  # noqa: E402

DATA = os.environ.get("FEIRA_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]",
        "feira-tests",
        **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="feira-tests-")},
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return DATA


@pytest.fixture(scope="session")
def sample(spark, folder):
    return CleanTables(sample_tables(spark, folder))
