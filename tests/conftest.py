import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("PAIRCRAFT_DRIVER_MEM", "4g")
    from paircraft.session import get_spark
    s = get_spark(master="local[2]", partitions=4)
    yield s
