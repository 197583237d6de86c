import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYTHONPATH", sys.path[0])

from depdelver.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", 2, "3g")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
