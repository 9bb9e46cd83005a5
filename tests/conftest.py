from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from funnelwright.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4, memory="6g")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
