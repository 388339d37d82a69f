import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shardloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("shardloom-tests", cores=8)


@pytest.fixture
def rows():
    """Collect a DataFrame as a sorted list of tuples."""

    def collect(df, *cols):
        return sorted(
            (tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr
        )

    return collect
