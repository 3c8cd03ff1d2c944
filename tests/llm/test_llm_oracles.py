"""Queries that SQL expresses give the SQL's rows."""

import pytest

from tessera.llm.oracles import ORACLES
from tessera.llm.queries import QUERIES
from tests.conftest import canonical


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, small, duck, name):
    got, want = QUERIES[name](spark, small).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
