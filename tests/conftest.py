import pytest

from tamarack.session import build_session, ship


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", 4, **{"spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.coalescePartitions.enabled": "true"})
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()
