import pytest

from arborlake.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(4)
    s.sparkContext.setLogLevel("ERROR")
    return s
