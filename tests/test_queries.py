import pytest
from oracle import connection, same

from panelkit import queries

SF = "/root/testdata/sf0.001"
FOUND, SQL = queries.queries(), queries.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(FOUND))
def test_matches_sql(spark, con, name):
    same(spark, con, SF, FOUND[name], SQL[name])


def test_flagship_plan(spark):
    """Three exchanges (bars, symbols, end times) and no join."""
    plan = queries.flagship(spark, SF)._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert "Join" not in initial
    assert initial.count("Exchange hashpartitioning") == 3


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["f_div", "f_div_zero", "m_inverse", "ts_zscore", "ts_corr", "ts_skewness", "m_pow_operator", "flagship"])
def test_same_without_ansi(spark, con, name):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        same(spark, con, SF, FOUND[name], SQL[name])
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
