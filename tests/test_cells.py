"""Searches by cells, in few dimensions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import kernels
from tessera.functions.kernels import KERNELS, Best, cells
from tessera.operators import flat, ivf, kmeans
from tessera.operators.ivf import IvfIndex


def _table(spark, x, name="vec_id"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} long, embedding array<double>").cache()


def _brute(q, x, k):
    d = np.floor(((q[:, None] - x[None]) ** 2).sum(axis=2) * 1e6 + 0.5) / 1e6
    return sorted((i, n + 1, int(j), float(d[i, j])) for i in range(len(q)) for n, j in enumerate(np.lexsort((np.arange(len(x)), d[i]))[:k]))


def _rows(df):
    return sorted(map(tuple, df.select("qid", "rank", "vec_id", "distance").collect()))


@pytest.mark.parametrize("d", [1, 2, 5])
def test_cells_meet_few_pairs_and_lose_none(d):
    draw = np.random.Generator(np.random.PCG64(8))
    x, q = draw.normal(size=(6000, d)).round(3), draw.normal(size=(1000, d))
    x[17], q[5] = np.nan, np.nan
    measured = []
    (a, cuts), (b, begin) = cells(q, kernels.TILE), cells(x, 64)
    assert sorted(b.tolist()) == list(range(6000)) and np.diff(np.append(begin, 6000)).max() <= 64
    best = Best(1000, 7, False)
    best.scan_cells(q[a], cuts, x[b], begin, b, lambda u, v: measured.append(len(u) * len(v)) or KERNELS["l2"](u, v), (np.arange(6000), np.ones(6000, dtype=int)))
    ids = np.empty((1000, 7), dtype=int)
    ids[a] = best.ids
    fine = np.flatnonzero(np.arange(1000) != 5)
    assert [(i, n + 1, int(v)) for i in fine for n, v in enumerate(ids[i])] == [(int(fine[i]), n, v) for i, n, v, _ in _brute(q[fine], np.nan_to_num(x, nan=1e9), 7)]
    assert d > 2 or sum(measured) < 6000 * 1000 / 4


def test_small_samples_are_trained_on_the_driver(spark):
    rows = spark.range(9000).select(F.col("id").alias("vec_id"), F.array((F.col("id") % 97).cast("double"), (F.col("id") % 89).cast("double")).alias("embedding"))
    sample = kmeans.first_vectors(rows, 700, 6666)
    want = rows.orderBy(kmeans.shuffled_order(), "vec_id").limit(700).select("embedding").collect()
    assert sample.tolist() == [r[0] for r in want]
    c = sample[:5]
    table = _table(spark, sample)
    params = kmeans.KMeansParams()
    assert np.allclose(kmeans.step(sample, c, params)[0], kmeans.step(table, c, params)[0])


def test_flat_search_by_cells(spark):
    draw = np.random.Generator(np.random.PCG64(9))
    x = draw.random(size=(3000, 2)).round(2)
    assert _rows(flat.knn(_table(spark, x[::50], "qid"), _table(spark, x), 10)) == _brute(x[::50], x, 10)


@pytest.mark.parametrize("opt", ["OPT_NONE", "OPT_TRIANGLE", "OPT_TRI_SUBNN_L2", "OPT_SUBNN_IP", "OPT_TRI_SUBNN_IP", "OPT_ALL"])
def test_index_search_by_cells(spark, opt):
    """Lists of many cells; distances so small that they tie after rounding, where the lesser id counts."""
    draw = np.random.Generator(np.random.PCG64(10))
    x = (draw.random(size=(5000, 2)) * [0.05, 0.02]).round(6)
    x[4000:] = x[draw.integers(0, 300, 1000)]
    base, queries = _table(spark, x), _table(spark, x[::40], "qid")
    index = IvfIndex.train(base, 4, opt=opt, params=kmeans.KMeansParams(niter=3)).add(base)
    assert _rows(index.search(queries, 10, 4)) == _brute(x[::40], x, 10)
    s = index.statistics(queries, 10, 4).first()
    assert s["total"] == 125 * 5000 == sum(s[c] for c in ("computed", "skip_tri", "skip_tri_large", "skip_l2", "skip_ip", "skip_cells"))
    assert s["skip_cells"] > 0


def test_tables_of_the_rules_only(spark):
    base = _table(spark, np.random.Generator(np.random.PCG64(11)).random(size=(200, 2)))
    made = {opt: set(IvfIndex.train(base, 2, opt=opt, params=kmeans.KMeansParams(niter=1)).add(base).rows.columns) for opt in (3, 5)}
    assert "near" in made[3] and "cos_near" not in made[3]
    assert "cos_near" in made[5] and "cos_far" in made[5] and "near" not in made[5]


def test_directions_of_the_plane_meet_their_neighbours_only():
    """A circle, a dense arc of it whose cosines tie after rounding, copies, the centroid and NaN."""
    draw = np.random.Generator(np.random.PCG64(12))
    x = np.unique(np.concatenate([draw.normal(size=(6000, 2)), np.stack([np.full(500, 3.0), draw.random(500) * 1e-3], axis=1)]).round(6), axis=0)
    x = np.concatenate([x, [[0.5, 0.25], [np.nan, 1.0]]])
    n, centre = draw.integers(1, 3, len(x)), np.array([0.5, 0.25])
    first = np.cumsum(n) - n
    ids = draw.permutation(n.sum())
    ids = np.concatenate([np.sort(ids[a : a + b]) for a, b in zip(first, n, strict=True)])
    q = np.concatenate([x[::5], x[-2:]])
    offered = []

    class Counted(Best):
        def offer(self, rows, distances, *more):
            offered.append(distances.size)
            super().offer(rows, distances, *more)

    bests = {name: Counted(len(q), 8, greatest) for name, greatest in (("cos_near", True), ("cos_far", False))}
    with np.errstate(invalid="ignore"):
        ivf._meet(bests, q, x, centre, ids, (first, n))
    unit = lambda v: v / np.where((s := np.linalg.norm(v, axis=1)) == 0, 1, s)[:, None]
    cosine = np.repeat(unit(q - centre) @ unit(x - centre).T, n, axis=1)
    for best in bests.values():
        keys = kernels.rounded(best.sign * cosine)
        for i in range(len(q) - 1):
            assert best.ids[i].tolist() == ids[np.lexsort((ids, keys[i]))[:8]].tolist()
    assert not np.isfinite(bests["cos_near"].keys[-1]).any()
    assert sum(offered) < 2 * len(q) * len(x) / 8


def test_a_search_reads_the_tables_of_pivots_only(spark, monkeypatch):
    draw = np.random.Generator(np.random.PCG64(13))
    x = draw.random(size=(3000, 2)).round(4)
    base, queries = _table(spark, x), _table(spark, x[::50], "qid")
    index = IvfIndex.train(base, 4, opt="OPT_SUBNN_IP", params=kmeans.KMeansParams(niter=2)).add(base)
    assert index.rows.filter("cos_near is null").count() == 0
    skipped = {}
    for pivot in (ivf.PIVOT, "false", "true"):
        monkeypatch.setattr(ivf, "PIVOT", pivot)
        assert _rows(index.search(queries, 10, 4)) == _brute(x[::50], x, 10)
        skipped[pivot] = index.statistics(queries, 10, 4).first()["skip_ip"]
    assert skipped.pop("false") == skipped.pop("true") == 0 < skipped.popitem()[1]


@pytest.mark.parametrize("d", [2, 9])
def test_neighbours_in_blocks_and_parts(spark, monkeypatch, d):
    """Blocks that ask and parts that are met: a row comes to a pair of them once, and none is lost."""
    x = np.random.Generator(np.random.PCG64(14)).random(size=(700, d)).round(3)
    base = _table(spark, x)
    index = IvfIndex.train(base, 3, opt=7, params=kmeans.KMeansParams(niter=2)).reset()
    columns = ["vec_id", "list_id", "near_ids", "near", "cos_near_ids", "cos_near", "cos_far_ids", "cos_far"]
    rows = lambda: sorted(map(str, index.add(base).rows.select(columns).collect()))
    whole = rows()
    monkeypatch.setattr(ivf, "SUB_BLOCK", 40)
    monkeypatch.setattr(ivf, "SUB_BYTES", 60 * (8 * d + 24))
    monkeypatch.setattr(ivf, "SPREAD_ROWS", 100)
    assert rows() == whole
