"""Every registered query of the base package against its SQL."""

import pytest

from hubflow.plans import queries as q
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_query(spark, con, name):
    assert_same(q.QUERIES[name](spark, SF), con, q.ORACLE[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
