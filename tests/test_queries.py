import pytest

from tallyspark.plans import analytics_queries, statement_queries
from tests.conftest import SF
from tests.oracle import connect, same

QUERIES = analytics_queries.QUERIES | statement_queries.QUERIES
SQL = analytics_queries.SQL | statement_queries.SQL


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    same(QUERIES[name](spark, SF), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_order_does_not_matter(spark):
    from tallyspark.operators import analytics as A
    from tallyspark.plans.fixtures import ledger

    rows = ledger(spark, SF)
    for f in (A.monthly_summary, A.balance_trend, A.cashflow_summary, A.recurring):
        assert f(rows).collect() == f(rows.repartition(7, "description")).collect()


def test_empty_ledger(spark):
    from tallyspark.operators import analytics as A
    from tallyspark.plans.fixtures import ledger

    none = ledger(spark, SF).where("false")
    assert A.monthly_summary(none).count() == A.category_breakdown(none).count() == A.anomalies(none).count() == A.recurring(none).count() == 0
    assert A.cashflow_summary(none).collect()[0]["total_in"] == 0.0
