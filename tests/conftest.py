import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from feedloom.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "feedloom-tests")
    yield session
    session.stop()


@pytest.fixture
def many_ranges(monkeypatch):
    """Take the distributed path also for small inputs."""
    from feedloom.operators import ordered

    monkeypatch.setattr(ordered, "SMALL_ROWS", 0)
