import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from tessella.session import local_session

    session = local_session("tests", cores=4, memory="4g")
    session.sparkContext.environment["PYTHONPATH"] = str(ROOT)
    yield session
    session.stop()
