import pytest

from corvane.session import local_session, ship_package


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("4", 4, **{"spark.checkpoint.dir": "file://" + str(tmp_path_factory.mktemp("shared")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()
