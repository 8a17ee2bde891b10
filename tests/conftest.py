"""One local session for all tests."""

from __future__ import annotations

import pytest

from siltline.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, 8)
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
