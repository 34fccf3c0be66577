import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent.parent}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from axonspark.session import session

    work = tmp_path_factory.mktemp("spark")
    s = session(
        "tests", spark__master="local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g", spark__sql__warehouse__dir=str(work / "warehouse"), spark__ui__showConsoleProgress="false"
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
