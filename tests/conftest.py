import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))
sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def spark():
    from tidewatch.session import local_session

    session = local_session(cores=8, partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
