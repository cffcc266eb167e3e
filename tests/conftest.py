import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pactlake import local_session
    from pactlake.streaming import ROCKSDB

    session = local_session(8, "6g", 4)
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    yield session
    session.stop()
