import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
for folder in (ROOT, ROOT / "tests"):
    sys.path.insert(0, str(folder))


@pytest.fixture(scope="session")
def spark():
    from wayfold.session import local_session

    session = local_session(8, 4, "wayfold-tests")
    yield session
    session.stop()
