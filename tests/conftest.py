import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tracewell.session import local_session, work_folder


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture
def folder(spark):
    return work_folder(spark, "test")


@pytest.fixture
def requests(spark):
    def build(texts, received=10**18, prefix="r"):
        rows = [(f"{prefix}{i:04d}", received + i, text) for i, text in enumerate(texts)]
        return spark.createDataFrame(rows, "request_key string, received_at_unix_nano bigint, value string")

    return build
