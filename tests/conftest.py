import pytest

from ionloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("8")
    yield session
    session.stop()
