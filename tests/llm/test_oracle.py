import pytest

from granary.llm.queries import QUERIES, SQL
from tests import oracle

pytestmark = pytest.mark.skipif(not oracle.available(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    oracle.same(spark, oracle.connection(), QUERIES[name], SQL[name])


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 11)}
