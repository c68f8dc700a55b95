"""One small local session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pathwright.session import build

    s = build("tests", cores="4", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
