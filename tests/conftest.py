import pytest

from leafmill.session import local_session, ship_package


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 2, "4g")
    s.sparkContext.setLogLevel("ERROR")
    ship_package(s)
    yield s
