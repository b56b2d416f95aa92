import pytest

from mediaframe.plans import queries as Q
from tests.oracle import compare, connect

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(D)


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, con, name, tmp_path):
    if name in Q.ORACLES:
        compare(spark, con, D, Q.QUERIES[name], Q.ORACLES[name])
    else:
        assert Q.QUERIES[name](spark, D).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(Q.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
