import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from barloom.session import build_session

    session = build_session("tests", 4)
    yield session
    session.stop()
