import pytest

from rollcall.session import drop_cuts, local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4, "4g")
    yield s
    drop_cuts(s)
    s.stop()
