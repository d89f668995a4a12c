import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from assay.functions.session import local_session

    session = local_session(4)
    session.sparkContext.setLogLevel("ERROR")
    folder = "file://" + str(tmp_path_factory.mktemp("checkpoints"))
    session.sparkContext.setCheckpointDir(folder)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()
