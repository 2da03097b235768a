"""One session for all tests."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from lakeloom.session import local_session

    s = local_session("tests", int(os.environ.get("TEST_CPUS", "8")), "6g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
