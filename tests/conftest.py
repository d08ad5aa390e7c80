import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from dossierlake import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session.build("tests", cores=8, **{"spark.sql.shuffle.partitions": "3"})
    yield s
    s.stop()
