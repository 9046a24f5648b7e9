"""Every registered query against its SQL on the smallest given tables."""
import os

import pytest

from driverqueries import CHECKS, QUERIES
from driverqueries.check import check, duck

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("key", list(QUERIES))
def test_query(spark, con, key):
    result, _, _ = check(spark, con, key, SF_DIR)
    assert result is None or result.startswith("rows only"), result


def test_every_query_has_a_check():
    assert set(CHECKS) == set(QUERIES)
