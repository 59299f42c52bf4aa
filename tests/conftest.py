import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from massloom.session import local_session, reach_workers  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = reach_workers(local_session("4", **{"spark.sql.shuffle.partitions": "4"}))
    yield session
    session.stop()
