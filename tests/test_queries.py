"""Every registered query against its SQL, and plan checks, at the smallest scale."""

import pytest

import check
from newsloom.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def duck():
    return check.duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BatchEvalPython" not in plan
    if name in SQL:
        assert check.compare(df, duck, SQL[name]) is None
    else:
        assert df.columns
        df.limit(5).collect()


def test_names_match():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_filters_reach_the_scan(spark):
    from datetime import date

    from newsloom.operators import marts
    from newsloom.plans import fixtures

    plan = marts.topic_mentions(fixtures.mentions(spark, SF), "weekly", date(2024, 1, 17))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-08" in plan and "LessThan(ts,2024-01-" in plan
    assert "props" not in plan.split("ReadSchema")[1].split("\n")[0]
