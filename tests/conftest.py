import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from siltstone.session import build_session

    session = build_session("tests", cpus=4, partitions=4, driver_memory="4g")
    yield session
    session.stop()
