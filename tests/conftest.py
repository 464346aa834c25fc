import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rasterweave.session import local_session, prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "tests", spark__sql__shuffle__partitions="4")
    s.sparkContext.setLogLevel("ERROR")
    prepare(s)
    yield s
    s.stop()
