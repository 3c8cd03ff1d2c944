"""Ranks and assignments go by distances of six decimals, as in SQL."""

import numpy as np
import pytest

from tessera.operators import kmeans
from tessera.operators.ivf import IvfIndex
from tessera.queries import ORACLES, QUERIES
from tests.conftest import canonical


def test_step_gives_ties_to_the_lesser_list(spark):
    """A vector nearer to the second centroid by less than the sixth decimal is the first one's."""
    rows = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1 + 1e-9, 0.0]), (2, [2.0, 0.0])], "vec_id long, embedding array<double>")
    new, _ = kmeans.step(rows, np.array([[0.0, 0.0], [2.0, 0.0]]), kmeans.KMeansParams())
    assert new.round(6).tolist() == [[0.5, 0.0], [2.0, 0.0]]


def test_neighbours_rank_by_distance_not_its_square(spark):
    """0.1 and 0.1000014 are the same when squared and rounded, but not before."""
    rows = spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.1000014, 0.0]), (2, [0.0, 0.1])], "vec_id long, embedding array<double>")
    index = IvfIndex.from_centroids(np.array([[5.0, 5.0]]), opt=2).add(rows)
    assert index.rows.filter("vec_id = 0").select("near_ids").first()[0] == [2, 1]


@pytest.mark.parametrize("name", ["subnn_l2", "subnn_cos_near", "subnn_cos_far"])
def test_neighbours_met_in_parts(spark, small, duck, monkeypatch, name):
    """Lists of several blocks that ask and several that are met give the SQL's rows, too."""
    monkeypatch.setattr("tessera.operators.ivf.SUB_BLOCK", 30)
    monkeypatch.setattr("tessera.operators.ivf.SUB_BYTES", 20 * (8 * 64 + 24))
    assert canonical(QUERIES[name](spark, small).toPandas()) == canonical(duck.sql(ORACLES[name]).df())
