import pytest

from textloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, partitions=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
