import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tests.compare import session

    s = session("8")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()
