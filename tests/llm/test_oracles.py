import pytest

from mediaframe.llm import queries
from mediaframe.llm.sql import ORACLES
from tests.oracle import compare, connect

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, name):
    compare(spark, connect(D), D, queries.queries()[name], ORACLES[name])
