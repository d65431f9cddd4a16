import pytest

from sievewright.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
