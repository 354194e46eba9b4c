import os

import pytest

from tidemark.session import local_session

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", 8, "tidemark-tests")
    yield session


@pytest.fixture(scope="session")
def sf_dir():
    return DATA
