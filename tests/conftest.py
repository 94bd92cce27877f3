import pytest

from pagewright.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "pagewright-tests")
    yield session
    session.stop()


SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF_SMALL
