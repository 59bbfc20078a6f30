import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from veredas.session import local_session

    session = local_session(4, partitions=4, memory="4g")
    yield session
    session.stop()
