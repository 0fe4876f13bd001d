import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from inkquest.session import build_session

    s = build_session("tests", "local[8]", spark__sql__shuffle__partitions=8, spark__ui__enabled="false",
                      spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
