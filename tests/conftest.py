import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from orrery.session import build

    s = build(master="local[4]", app="tests", shuffle_partitions=4, spark__ui__enabled="false", spark__driver__memory="3g", spark__sql__adaptive__coalescePartitions__enabled="true")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
