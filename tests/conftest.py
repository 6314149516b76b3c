import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

import oracle_check  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = oracle_check.session()
    yield session
    session.stop()
