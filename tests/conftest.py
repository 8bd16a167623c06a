import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from trailmark.session import local_session

    session = local_session(name="tests")
    yield session
    session.stop()


def rows(df, *order):
    """Rows as dicts, ordered by the given columns."""
    found = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(found, key=lambda r: tuple(str(r[c]) for c in order)) if order else found


def keyed(df, key, value):
    return {r[key]: r[value] for r in df.collect()}
