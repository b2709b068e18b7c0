import pytest

from corpusloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("8", memory="8g")
