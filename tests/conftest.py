import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from harborlight.session import local_session

    return local_session(int(os.environ.get("TEST_CPUS", "4")), app="tests")


@pytest.fixture(scope="session")
def data():
    return DATA
