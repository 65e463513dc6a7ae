import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quirelake.runtime import session, ship

    s = session("tests", cores=4, spark__sql__shuffle__partitions="4")
    ship(s)
    yield s
    s.stop()


DATA = os.environ.get("QUIRELAKE_TESTDATA", "/root/testdata/sf0.001")
