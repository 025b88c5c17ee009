import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from corpuskit.session import local_session

    session = local_session("tests")
    yield session
    session.stop()
