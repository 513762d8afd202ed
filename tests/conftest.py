import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("SURVEYMEND_DRIVER_MEMORY", "6g")
    from surveymend.session import local_session

    s = local_session("tests", "8", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
