import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import check  # noqa: E402
from plotweave.session import ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return ship(check.session())
