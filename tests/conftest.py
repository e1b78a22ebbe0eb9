import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from sedgewren.session import local_session

    s = local_session(4, memory="4g", partitions=4, name="tests")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
