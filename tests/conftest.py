import pytest

from tidegauge.session import get_spark


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_spark("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false",
        # keep several partitions even for small frames, or nothing distributed would be tested
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    })
    session.sparkContext.setLogLevel("FATAL")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()
