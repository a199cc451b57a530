import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from terraloom.session import build_session

    session = build_session(4, shuffle_partitions="4", **{"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
