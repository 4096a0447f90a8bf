import random

import pytest


@pytest.fixture
def rnd():
    return random.Random(20240229)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
