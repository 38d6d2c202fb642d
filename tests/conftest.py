import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from blocklens.session import ship_package  # noqa: E402
from checks.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8")
    ship_package(session)
    return session


@pytest.fixture(scope="session")
def data():
    return DATA
