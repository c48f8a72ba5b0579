import os

import pytest

from recall.plans import checkpoint
from tests.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    yield session
    checkpoint.clear(session)
    folder = session.sparkContext.getCheckpointDir()
    if folder is not None:
        left = [x for x in os.listdir(folder.removeprefix("file:")) if x.startswith("recall-")]
        assert not left, "intermediate tables are left"
