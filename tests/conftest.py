import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from loghound.session import build_session
    s = build_session("loghound-tests", master="local[4]", shuffle_partitions=4)
    yield s
    s.stop()


def lines_df(spark, lines):
    return spark.createDataFrame([(i, "fixture", v) for i, v in enumerate(lines)],
                                 "ord bigint, file_path string, value string")
