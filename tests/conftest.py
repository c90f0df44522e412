import pytest

from soundledger.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("4", "tests", **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()
