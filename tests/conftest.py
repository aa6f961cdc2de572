import sys
import tempfile
from datetime import datetime, timezone
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from compare import SF_DIR  # noqa: E402

from stratiform.session import build_session  # noqa: E402

@pytest.fixture(scope="session")
def spark():
    base = tempfile.mkdtemp(prefix="stratiform-tests-")
    session = build_session(
        "tests",
        spark__master="local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
        spark__checkpoint__dir=f"{base}/shared",
        spark__sql__warehouse__dir=f"{base}/warehouse",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def audit_ts():
    return datetime(2025, 1, 1, tzinfo=timezone.utc)
