import os

import pytest

SMALLEST = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from paneloom.session import build_session

    session = build_session("tests", "local[8]", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    if not os.path.isdir(SMALLEST):
        pytest.skip("test tables are not here")
    return SMALLEST
