"""Every registered query of the map-tile library against its SQL in DuckDB; those without SQL must give rows."""

import pytest

from compare import same
from tilelake.plans import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(name, spark, data, duck):
    got = queries.QUERIES[name](spark, data)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    same(got, queries.ORACLES[name], duck)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_gives_rows(name, spark, data):
    assert queries.QUERIES[name](spark, data).count() > 0
