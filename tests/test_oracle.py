import pytest

from granary.queries import QUERIES, SQL
from tests import oracle

pytestmark = pytest.mark.skipif(not oracle.available(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connection()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    oracle.same(spark, con, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, oracle.SF).count() > 0


#: Minus zero, exponents in SQL's text and not in JavaScript's, and none in either.
ODD = [-0.0, 0.0, 5.0, -5.0, 0.01, -0.25, 1e-4, 9e-5, -2.3e-7, 123456.75, 1e7, 12345678.5, 1e15, 1e16, -1.5e17, 1e21, 1e100, 1e-100, float("nan"), float("inf"), float("-inf")]


@pytest.mark.parametrize("name", ["r02_csv_lines", "r11_format_sizes"])
def test_odd_doubles_against_sql(spark, con, tmp_path, name):
    rows = [(k, f"Customer#{k:09d}", k % 25, x, "MACHINERY") for k, x in enumerate(ODD)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    own = con.cursor()
    own.execute(f"CREATE TEMP VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    oracle.same(spark, own, lambda s, _: QUERIES[name](s, str(tmp_path)), SQL[name])
