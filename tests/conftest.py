import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from graphloom.session import local_session, ship

    session = local_session(cores=4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return ship(session)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
