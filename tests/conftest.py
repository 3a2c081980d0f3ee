import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from codesieve.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", app="tests", **{"spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def files(spark):
    """A files table from (path, language, code) triples."""
    def make(*rows, scan_id="s"):
        return spark.createDataFrame(
            [(scan_id, path, language, code) for path, language, code in rows],
            "scan_id string, file_path string, language string, code string")
    return make
