import pytest
from verify import session


@pytest.fixture(scope="session")
def spark():
    return session()
