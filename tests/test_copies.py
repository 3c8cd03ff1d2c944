"""Tables in which each vector is there many times."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import kernels
from tessera.functions.kernels import KERNELS, Best, runs_of_equals
from tessera.operators import evaluate, flat, ivf, kmeans, maintain
from tessera.operators.ivf import IvfIndex


@pytest.fixture(scope="module")
def copies(spark):
    """(vectors, queries, their rows by brute force): 30 different vectors, 20 times each; an id of
    two vectors, too."""
    draw = np.random.Generator(np.random.PCG64(3))
    x = np.concatenate([np.tile(draw.normal(size=(30, 2)).round(2), (20, 1)), [[9.0, 9.0]]])
    ids = np.append(np.arange(600), 599)
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").cache()
    queries = rows.filter("vec_id % 7 = 0 or vec_id >= 590").dropDuplicates(["vec_id"]).filter("vec_id < 599").withColumnRenamed("vec_id", "qid").cache()
    want = []
    for qid, q in queries.collect():
        d = np.floor(((x - np.array(q)) ** 2).sum(axis=1) * 1e6 + 0.5) / 1e6
        want += [(qid, n + 1, int(ids[i]), float(d[i])) for n, i in enumerate(np.lexsort((ids, d))[:25])]
    return rows, queries, sorted(want)


def _rows(df):
    return sorted(map(tuple, df.select("qid", "rank", "vec_id", "distance").collect()))


def test_searches_measure_copies_once_and_return_all(copies):
    rows, queries, want = copies
    assert _rows(flat.knn(queries, rows, 25)) == want
    near = {(q, v, d) for q, _, v, d in _rows(flat.knn(queries, rows, 601)) if d < 0.5}
    index = IvfIndex.train(rows, 4, opt=7, params=kmeans.KMeansParams(niter=2)).add(rows)
    for opt in (0, 1, 6, 7):
        assert _rows(index.search(queries, 25, 4, opt)) == want
    s = index.statistics(queries, 25, 4).first()
    assert s["total"] == queries.count() * 601
    assert s["computed"] + s["skip_tri"] + s["skip_tri_large"] + s["skip_l2"] + s["skip_ip"] == s["total"]
    found = index.range_search(queries, 0.5, 4).collect()
    assert len(found) == len(near) and {tuple(r) for r in found} == near
    random = IvfIndex(index.centroids, index.rows, opt=7).with_random_neighbours()
    assert _rows(random.search(queries, 25, 4)) == want


def test_equal_vectors_are_one_run():
    x = np.array([[1.0, 2.0], [0.0, 1.0], [1.0, 2.0], [0.0, 1.0], [1.0, 2.5]])
    ids = np.array([7, 3, 5, 9, 1])
    order, first = runs_of_equals(x, ids)
    assert ids[order].tolist() == [3, 9, 5, 7, 1] and first.tolist() == [0, 2, 4]
    best = Best(1, 3, False)
    best.offer(np.array([0]), KERNELS["l2"](np.array([[1.0, 2.0]]), x[order[first]]), ids[order], None, (first, np.diff(np.append(first, 5))))
    assert best.ids.tolist() == [[5, 7, 1]] and best.keys.tolist() == [[0.0, 0.0, 0.25]]


def test_expanding_keeps_what_can_be_among_the_best(spark, copies):
    rows, queries, want = copies
    one, members = maintain.deduplicated(rows.filter("embedding[0] < 9"))
    found = flat.knn(queries, one, 25).drop("rank")
    few = maintain.expanded(found, members, 5)
    assert few.count() == found.count() * 5 < maintain.expanded(found, members).count()
    first = few.groupBy("qid").agg(F.min(F.struct("distance", "vec_id")).alias("b")).select("qid", "b.vec_id", "b.distance")
    assert {tuple(r) for r in first.collect()} == {(q, v, d) for q, n, v, d in want if n == 1}


def test_columns_beyond_the_kth_row_are_not_expanded(monkeypatch):
    """400 vectors of 20 rows each: the nearest one alone fills a query's k."""
    expanded = []
    plain = kernels.members
    monkeypatch.setattr(kernels, "members", lambda begin, n: expanded.append(int(n.sum())) or plain(begin, n))
    x = np.random.Generator(np.random.PCG64(4)).normal(size=(400, 2))
    q, n = x[:50] + 1e-3, np.full(400, 20)
    n[::7] = 1
    best, first = Best(50, 10, False), np.cumsum(n) - n
    d = KERNELS["l2"](q, x)
    best.offer(np.arange(50), d, np.arange(n.sum()), None, (first, n))
    each = np.repeat(d, n, axis=1)
    key = kernels.rounded(each)
    assert all(best.ids[i].tolist() == np.lexsort((np.arange(n.sum()), key[i]))[:10].tolist() for i in range(50))
    assert expanded[0] <= 50 * 2 * 10


@pytest.mark.parametrize("most", [7, 30])
def test_equal_vectors_come_together_but_for_very_many(copies, most):
    rows, _, _ = copies
    spots = ivf._spot(rows, most).groupBy("embedding").agg(F.countDistinct("spot").alias("spots"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in spots) == 601
    assert all(r["spots"] == 1 for r in spots) if most == 30 else max(r["spots"] for r in spots) > most


def test_an_index_of_one_partition_is_dealt_to_all_cores(copies, monkeypatch):
    rows, queries, want = copies
    monkeypatch.setattr("tessera.operators.ivf.SPREAD_ROWS", 100)
    index = IvfIndex.train(rows, 4, params=kmeans.KMeansParams(niter=2)).add(rows.coalesce(1))
    parts = index.rows.groupBy(F.spark_partition_id().alias("at")).count().count()
    assert parts > 1 and index.rows.count() == 601
    assert _rows(index.search(queries, 25, 4)) == want


def test_neighbours_of_copies_in_blocks(copies, monkeypatch):
    """The tables are the same whether equal vectors ask in one block or, being very many, in several."""
    rows, _, _ = copies
    index = IvfIndex.train(rows, 3, opt=7, params=kmeans.KMeansParams(niter=2)).reset()
    columns = ["vec_id", "embedding", "near_ids", "near", "cos_near_ids", "cos_near", "cos_far_ids", "cos_far"]
    whole = sorted(map(str, index.add(rows).rows.select(columns).collect()))
    for block in (40, 200):
        monkeypatch.setattr("tessera.operators.ivf.SUB_BLOCK", block)
        assert sorted(map(str, index.add(rows).rows.select(columns).collect())) == whole


def test_recall_makes_the_truth_once(spark):
    truth = spark.createDataFrame([(1, 1, 5, 0.5), (1, 2, 6, 1.0), (2, 1, 7, 0.5), (2, 2, 8, 1.0)], "qid long, rank int, vec_id long, distance double")
    found = spark.createDataFrame([(1, 1, 5, 0.5), (1, 2, 9, 1.0), (3, 1, 7, 0.5)], "qid long, rank int, vec_id long, distance double")
    made = truth.mapInArrow(lambda batches: batches, truth.schema)
    recall = evaluate.recall_at_k(found, made, 2)
    assert tuple(recall.first()) == (0.5, 0.25)
    assert recall._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


@pytest.mark.parametrize("d", [1, 2, 5])
def test_neighbours_are_met_outwards(monkeypatch, d):
    """The rows of measuring all, the centroid among them, from a small share of the pairs."""
    monkeypatch.setattr("tessera.operators.ivf.WINDOW", 16)
    monkeypatch.setattr(kernels, "TILE", 16)
    draw = np.random.Generator(np.random.PCG64(5))
    x = np.unique(draw.normal(size=(3000, d)).round(3), axis=0)
    centre, n = x[len(x) // 2].copy(), draw.integers(1, 4, len(x))
    ids, first, q = draw.permutation(n.sum()), np.cumsum(n) - n, np.concatenate([x[::9], centre[None]])
    ids = np.concatenate([np.sort(ids[a : a + b]) for a, b in zip(first, n, strict=True)])
    offered = []

    class Counted(Best):
        def offer(self, rows, distances, ids, allowed=None, copies=None):
            offered.append(distances.size)
            super().offer(rows, distances, ids, allowed, copies)

    bests = {name: Counted(len(q), 6, greatest) for name, greatest in (("near", False), ("cos_near", True), ("cos_far", False))}
    ivf._meet(bests, q, x, centre, ids, (first, n))
    unit = lambda v: (v - centre) / np.maximum(np.linalg.norm(v - centre, axis=1), 1e-300)[:, None]
    cosine = unit(q) @ unit(x).T
    for name, key in (("near", np.sqrt(((q[:, None] - x[None]) ** 2).sum(axis=2))), ("cos_near", -cosine), ("cos_far", cosine)):
        key = np.repeat(kernels.rounded(np.where(name == "cos_near", -1, 1) * key) * np.where(name == "cos_near", -1, 1), n, axis=1)
        for i in range(len(q)):
            assert bests[name].ids[i].tolist() == ids[np.lexsort((ids, key[i]))[:6]].tolist()
    assert d != 2 or sum(offered) < 3 * len(q) * len(x) / 2
