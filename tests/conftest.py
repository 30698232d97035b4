from __future__ import annotations

import pytest

from foliant.session import build


@pytest.fixture(scope="session")
def spark():
    session = build(master="local[2]", shuffle_partitions=2, memory="2g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
