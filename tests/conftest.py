import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tabforge.session import get_spark
    s = get_spark(master="local[4]", shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tmp_dir():
    import tempfile
    return tempfile.mkdtemp(prefix="tabforge-test-", dir="/tmp")
