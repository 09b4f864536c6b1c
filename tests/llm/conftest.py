import pytest

from tests.conftest import SF_SMALL


@pytest.fixture(scope="session")
def sf_small():
    return SF_SMALL
