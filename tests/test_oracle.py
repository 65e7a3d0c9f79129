"""Every query with SQL gives the same rows as that SQL."""

import pytest

from driverbind.catalog import QUERIES
from driverbind.statements import STATEMENTS
from tests.oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_query(spark, duck, name):
    assert compare(spark, duck, FOLDER, QUERIES[name], STATEMENTS[name]) is None
