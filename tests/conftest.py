import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from holdfast.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "6g", "holdfast-tests")
    yield session
    session.stop()


@pytest.fixture
def rows():
    def collect(df):
        return [r.asDict(recursive=True) for r in df.collect()]

    return collect
