"""One local session for all tests."""

import pytest

from sparksift.session import local


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local("sparksift-tests", cpus="4", partitions=4, memory="4g")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()
