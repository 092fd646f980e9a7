import pytest

from skeinwork.session import get_session


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", cores="8", shuffle_partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
