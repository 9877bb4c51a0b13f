import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shardwright.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores="*", shuffle_partitions=8, app="shardwright-tests")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shardwright-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf001():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def sf0001():
    return "/root/testdata/sf0.001"
