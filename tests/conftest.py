import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import harness


@pytest.fixture(scope="session")
def spark():
    return harness.session()
