"""Every query that has SQL gives the SQL's rows; every other one runs."""

import pytest

from tessera.queries import ORACLES, QUERIES
from tests.conftest import canonical


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, small, duck, name):
    got, want = QUERIES[name](spark, small).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", ["subnn_l2", "subnn_cos_near", "subnn_cos_far"])
def test_neighbours_across_blocks(spark, small, duck, monkeypatch, name):
    """Lists of several blocks give the SQL's rows, too."""
    monkeypatch.setattr("tessera.operators.ivf.SUB_BLOCK", 20)
    assert canonical(QUERIES[name](spark, small).toPandas()) == canonical(duck.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry_points(spark, small):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
