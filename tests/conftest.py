import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rillet.session import checkpoint_root, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=4, shuffle_partitions=4, app="rillet-tests")
    checkpoint_root(s)
    yield s
    s.stop()


def rows(df, order=None):
    """Collected rows as sorted tuples (order-insensitive comparison)."""
    out = [tuple(r) for r in df.collect()]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))
