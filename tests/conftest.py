from __future__ import annotations

import pytest

from corrobora.local import local_session
from corrobora.session import clear_run


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8)
    yield session
    clear_run(session)
    session.stop()
