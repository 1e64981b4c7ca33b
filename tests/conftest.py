import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from fragmill.session import session

    s = session("tests", 8, **{"spark.driver.memory": "6g"})
    yield s
    s.stop()
