import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from tallymill.session import clear_scratch, session

    s = session("tests", cpus=4, spark__sql__shuffle__partitions="4", spark__driver__memory="3g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    clear_scratch(s)
    s.stop()


@pytest.fixture(scope="session")
def smallest():
    folder = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
    if not folder.exists():
        pytest.skip("no test tables here")
    return str(folder)
