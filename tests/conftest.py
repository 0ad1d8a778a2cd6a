import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from viewtide.session import local_session

    session = local_session("viewtide-tests", cores=4, shuffle_partitions=4)
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return DATA


GOLDEN = [
    (0, 1, "s1", "a", 0, 4),
    (1, 1, "s2", "b", 5, 6),
    (2, 2, "s1", "a", 5415, 5419),
    (3, 1, "s1", "a", 21600, 21605),
    (4, 2, "s3", "c", 86399, 86400),
    (5, 3, "s2", "b", 86400, 86402),
    (6, 2, "s1", "a", -1, 2),
    (7, 1, "s4", "b", 604800, 604816),
]


@pytest.fixture(scope="session")
def golden(spark):
    from viewtide.schema import INTERACTIONS

    rows = [(*r, r[5] - r[4]) for r in GOLDEN]
    return spark.createDataFrame(rows, INTERACTIONS)
