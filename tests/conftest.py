import pytest

from tests.check import connect
from tidemark.session import local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(partitions=4, memory="8g", name="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    return connect(SMALL)
