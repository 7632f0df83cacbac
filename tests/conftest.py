import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tests.check_oracles import duck  # noqa: E402
from tests.session import local_session  # noqa: E402
from vectrail.deploy import ship  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4)
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duckdb_small():
    return duck(SMALL)
