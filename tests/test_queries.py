import pytest

from tests.oracle import SF, compare
from tidelog.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    n = compare(QUERIES[name](spark, SF), ORACLE_SQL[name])
    assert n > 0 or name == "q08_seek_past_end"


def test_no_python_in_plans(spark):
    for name, f in QUERIES.items():
        plan = f(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan, name
