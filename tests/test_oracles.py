"""Every registered query beside its SQL counterpart on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import connect, mismatch

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    frame = queries()[name](spark, SF_DIR)
    sql = oracle_sql().get(name)
    if sql is None:
        assert frame.count() > 0
    else:
        assert mismatch(frame, con, sql) is None


def test_every_counterpart_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry(spark).count() == 1
