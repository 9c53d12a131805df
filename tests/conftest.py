import pytest

from larder.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[*]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.log.level": "ERROR",
            "spark.sql.maxMetadataStringLength": "1000",  # plans show the paths they read, however deep the temp folder lies
        },
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from larder.sources.standins import Standins

    return Standins(spark, "/root/testdata/sf0.001")
