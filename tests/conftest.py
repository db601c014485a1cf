import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from heliodor.plans.session import local_session

    session = local_session("tests", 4, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
