import pytest

from foliant.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", cores="4", shuffle=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
