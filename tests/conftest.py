import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYTHONPATH", sys.path[0])


@pytest.fixture(scope="session")
def spark():
    from quire.session import local_session

    session = local_session()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
