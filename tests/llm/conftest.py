import os

import pytest

MIDDLE = "/root/testdata/sf0.1"


@pytest.fixture(scope="session")
def middle():
    if not os.path.isdir(MIDDLE):
        pytest.skip("test tables are not here")
    return MIDDLE
