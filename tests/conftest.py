import pytest

from tidewatch.plans.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
