import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]


@pytest.fixture(scope="session")
def spark():
    from newsloom.session import build_session

    session = build_session("newsloom-tests", 8, shuffle_partitions=8, memory="8g")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
