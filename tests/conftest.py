import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from countersign.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, app="countersign-tests")
    yield session
    session.stop()


def rows(df, *columns):
    """Sorted tuples of a frame, for comparing without order."""
    columns = columns or df.columns
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)
