"""Every registered query against its DuckDB oracle SQL on the smallest driver tables."""

import pytest

from mktlens.oracle.compare import check

SF = "/root/testdata/sf0.001"


def test_all_queries_match_oracle(spark):
    res = check(spark, SF, verbose=False)
    bad = {k: v for k, v in res.items() if v != "ok" and not v.startswith("rows-only")}
    assert not bad, bad


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["category_id", "date", "order_amount", "revenue", "average_bill", "available_amount"]
    assert df.count() > 0


@pytest.mark.parametrize("key", ["category_daily", "category_rollup_prev"])
def test_plans_have_no_python_udf(spark, key):
    import __spark_entry__ as E
    plan = E.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_single_category_equals_set_based(spark):
    """The per-id API (scope_of) gives the same rows as the all-scopes query filtered to that id."""
    from pyspark.sql import functions as F

    from mktlens.operators.daily import daily_state
    from mktlens.operators.hierarchy import scope_of, scope_table
    from mktlens.plans.categories import category_daily
    from mktlens.sources import fixtures as X
    cats = X.categories(spark, SF)
    daily = daily_state(X.snap_events(spark, SF))
    for cid in (1001, 2003):
        one = category_daily(daily, scope_of(cats, cid), "2024-01-02", "2024-01-30")
        every = category_daily(daily, scope_table(cats), "2024-01-02", "2024-01-30").filter(F.col("category_id") == cid)
        assert sorted(one.collect()) == sorted(every.collect())
