import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from slotpack.session import local_session
    s = local_session("*", shuffle_partitions=8, app="slotpack-tests")
    yield s


SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"
