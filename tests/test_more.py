"""Large query blocks, batch searches, storage, descriptions, codes, files, timers, table functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import kernels
from tessera.operators import batch, flat, kmeans, maintain, quantize, transform
from tessera.operators.ivf import IvfIndex, axis_rule, sub_index_size
from tessera.plans import factory, sql, tuning
from tessera.sources import named, results, vecs


@pytest.fixture(scope="module")
def cloud(spark):
    draw = np.random.Generator(np.random.PCG64(15))
    x = (draw.normal(size=(30, 6))[draw.integers(0, 30, 900)] * 4 + draw.normal(size=(900, 6)) * 0.3).round(3)
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").cache()
    queries = base.filter("vec_id % 45 = 0").withColumnRenamed("vec_id", "qid").cache()
    return base, queries, x


def rows(df):
    return sorted(map(tuple, df.select("qid", "rank", "vec_id", "distance").collect()))


def test_memory_of_a_full_block_is_bounded():
    """16,384 queries against a step of the base: no matrix of all distances at once."""
    import tracemalloc

    draw = np.random.Generator(np.random.PCG64(1))
    q, x = draw.normal(size=(flat.BLOCK_ROWS, 4)), draw.normal(size=(flat.STEP, 4))
    best = kernels.Best(len(q), 3, False)
    tracemalloc.start()
    best.scan(q[:2048], x, np.arange(len(x)), kernels.KERNELS["l2"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6  # 134 MB would be one full matrix of these, and a block has eight times as many
    d = ((q[7] - x) ** 2).sum(axis=1)
    assert best.ids[7].tolist() == d.argsort()[:3].tolist()


def test_blocks_of_queries(spark, cloud, monkeypatch):
    base, queries, _ = cloud
    want = rows(flat.knn(queries, base, 5))
    monkeypatch.setattr(flat, "BLOCK_ROWS", 7)
    monkeypatch.setattr(kernels, "TILE", 3)
    assert rows(flat.knn(queries, base, 5)) == want
    assert len(list(flat.query_blocks(queries))) == 3


@pytest.mark.parametrize("metric", ["cosine", "jaccard", "bray_curtis"])
def test_distances_without_a_meaning_are_no_results(spark, metric):
    from tessera.functions.vectors import METRICS

    base = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    zero = base.filter("vec_id = 0").withColumnRenamed("vec_id", "qid")
    found = [r["vec_id"] for r in flat.knn(zero, base, 5, metric).collect()]
    assert 0 not in found
    pair = base.filter("vec_id = 0").select(METRICS[metric][0](F.col("embedding"), F.col("embedding")).alias("d")).first()["d"]
    assert pair is None


def test_batch_search_goes_on(spark, cloud, tmp_path):
    base, queries, _ = cloud
    index = IvfIndex.train(base, 8, params=kmeans.KMeansParams(niter=3)).add(base)
    want, path = rows(index.search(queries, 5, 3)), str(tmp_path / "b")
    assert rows(batch.big_batch(index, queries, 5, 3, path, slices=3, rows=50, most=4)) == want
    # a slice that is missing is made again, the others are read
    import shutil

    shutil.rmtree(f"{path}/1")
    before = (tmp_path / "b/0/_SUCCESS").stat().st_mtime_ns
    assert rows(batch.big_batch(index, queries, 5, 3, path, slices=3, rows=50, most=4)) == want
    assert (tmp_path / "b/0/_SUCCESS").stat().st_mtime_ns == before
    assert rows(batch.running_knn(queries, base, 5, str(tmp_path / "r"), 3)) == rows(flat.knn(queries, base, 5))


def test_axis_rule_is_sound_and_search_exact(cloud):
    base, queries, x = cloud
    q, c = x[::90], x.mean(axis=0)
    d = np.linalg.norm(q[:, None] - x[None], axis=2)
    bound = np.sort(d, axis=1)[:, 4]
    skip = axis_rule(x, q, c, bound, 6)
    assert skip.any() and (d[skip] > np.broadcast_to(bound[:, None], d.shape)[skip]).all()
    index = IvfIndex.train(base, 10, params=kmeans.KMeansParams(niter=3)).add(base)
    assert rows(index.search(queries, 5, 10, axes=6)) == rows(flat.knn(queries, base, 5))
    s = index.statistics(queries, 5, 10, axes=6).first()
    assert s["skip_axes"] > 0 and s["computed"] + s["skip_tri"] + s["skip_tri_large"] + s["skip_axes"] == s["total"]


def test_random_neighbours_lose_nothing(cloud):
    base, queries, _ = cloud
    index = IvfIndex.train(base, 6, opt=7, params=kmeans.KMeansParams(niter=3))
    lite = IvfIndex(index.centroids, index.placed(base), opt=7, sub_k=10).with_random_neighbours()
    assert rows(lite.search(queries, 5, 6)) == rows(flat.knn(queries, base, 5))
    assert sub_index_size(100, 50, 8) == (13, 8) and sub_index_size(100, 50, 8, "ip") == (13, 12) and sub_index_size(3, 5, 9) == (1, 1)


def test_sample_without_a_global_sort(spark):
    base = spark.range(5000).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double")).alias("embedding"))
    want = {r[0] for r in base.orderBy(kmeans.shuffled_order(), "vec_id").limit(700).collect()}
    assert {r[0] for r in kmeans.first_of(base, 700, 6666).collect()} == want
    assert kmeans.first_of(base, 9999, 6666).count() == 5000


def test_kmeans_goes_on(spark, cloud, tmp_path):
    base, _, _ = cloud
    params, path = kmeans.KMeansParams(niter=4), str(tmp_path / "k")
    kmeans.resumable(base, 5, path, kmeans.KMeansParams(niter=2))
    model = kmeans.resumable(base, 5, path, params)
    assert len(model.history) == 2 and np.allclose(model.centroids, kmeans.train(base, 5, params).centroids)
    assert model.assign(base).count() == 900


def test_moments(spark, cloud):
    base, _, x = cloud
    n, mean, cov = transform.moments(base.repartition(5))
    assert n == 900 and np.allclose(mean, x.mean(axis=0)) and np.allclose(cov, np.cov(x.T, bias=True))
    even = transform.pca(base, 4, bins=2)
    y = (x @ even.a.T + even.b).var(axis=0)
    plain = transform.pca(base, 4)
    z = (x @ plain.a.T + plain.b).var(axis=0)
    assert np.allclose(sorted(y), sorted(z)) and abs(y[:2].sum() - y[2:].sum()) <= abs(z[:2].sum() - z[2:].sum())


@pytest.mark.parametrize("text", ["IVF4,SQ8", "IVF4,RQ2x4", "IVF4,LSQ2x4", "MinMax8", "IVF4,MinMax8", "LSHt", "IVF4,PQ2x4,RFlat", "IVF4,Flat", "PCA4,SQ8", "HNSW8", "LSH", "IDMap,Flat"])
def test_descriptions_and_storage(spark, cloud, tmp_path, text):
    base, queries, _ = cloud
    index = factory.build(text).train(base).add(base).set("nprobe=4")
    found = rows(index.search(queries, 5))
    assert len(found) == 100
    index.save(str(tmp_path / "i"))
    assert rows(factory.Index.load(spark, str(tmp_path / "i")).search(queries, 5)) == found
    assert tuning.stored_bytes(spark, str(tmp_path / "i")) > 0


def test_external_ids(spark, cloud):
    base, queries, _ = cloud
    outside = base.select((F.col("vec_id") * 7 + 5).alias("external_id"), "embedding")
    index = factory.build("IDMap,Flat").train(base).add(outside.filter("external_id < 3000")).add(outside.filter("external_id >= 3000"))
    assert [(q, r, (i - 5) // 7, d) for q, r, i, d in rows(index.search(queries, 4))] == rows(flat.knn(queries, base, 4))


def test_ways_to_search_product_codes(spark, cloud):
    base, queries, x = cloud
    pq = quantize.ProductQuantizer.train(x, 3, 5)
    codes, q = pq.encode(x), x[:4]
    for kind in ("asymmetric", "symmetric", "hamming", "generalised"):
        assert pq.searching(kind).distances(q, codes).shape == (4, 900)
    assert np.allclose(pq.searching("symmetric").distances(q, codes), ((pq.decode(codes[:4])[:, None] - pq.decode(codes)[None]) ** 2).sum(axis=2))
    with pytest.raises(ValueError):
        pq.searching("other").distances(q, codes)
    # numbers that follow distances: the same codewords, and bits that tell more about distances
    turned = pq.reordered(4000)
    assert np.allclose(turned.decode(turned.encode(x)), pq.decode(codes))

    def follows(p):
        c, rest = p.encode(x[:200]), np.triu_indices(200, 1)
        return np.corrcoef(p.searching("hamming").distances(x[:200], c)[rest], p.symmetric(c, c)[rest])[0, 1]

    assert follows(turned) > follows(pq)
    assert pq.searching("polysemous", 15).search(queries, pq.encoded(base), 3).count() == 60


def test_more_codes(cloud):
    x = cloud[2]
    whole = quantize.ResidualQuantizer.train(x, 3, 4)
    norm = quantize.NormCoded.train(x, whole, 12)
    codes = norm.encode(x)
    exact = kernels.KERNELS["l2"](x[:5], norm.decode(codes))
    assert np.abs(norm.distances(x[:5], codes) - exact).max() < 0.01 * exact.max()
    for half in (False, True):
        rowwise = quantize.RowwiseMinMax(8, half)
        assert np.abs(rowwise.decode(rowwise.encode(x)) - x).max() < 0.1
    assert len(quantize.lattice_points(2, 25)) == 12 and (quantize.lattice_points(3, 6) ** 2).sum(axis=1).tolist() == [6] * 24
    ranked = quantize.RankedLattice(2, 6, 6)
    assert ranked.encode(x).shape == (900, 2) and ranked.encode(x).max() < 24


def test_models_are_stored_whole(spark, cloud, tmp_path):
    x = cloud[2]
    made = [quantize.ProductQuantizer.train(x, 2, 3), quantize.TwoLevel.around(x, 3, lambda r: quantize.ResidualQuantizer.train(r, 2, 3)), quantize.Lattice.train(x, 2, 5), quantize.HalfFloat(), quantize.SignBits.train(x, True)]
    for i, q in enumerate(made):
        quantize.save(q, spark, str(tmp_path / str(i)))
        back = quantize.load(spark, str(tmp_path / str(i)))
        assert type(back) is type(q) and np.array_equal(back.encode(x), q.encode(x))


def test_raw_results_and_named_sets(spark, cloud, tmp_path):
    base, queries, _ = cloud
    found = flat.knn(queries.withColumn("qid", F.expr("qid div 45")), base.filter("vec_id < 3"), 5)
    assert results.write_raw(found, str(tmp_path / "raw.bin"), 5) == 20
    back = {(r["qid"], r["rank"]): (r["vec_id"], r["distance"]) for r in results.read_raw(spark, str(tmp_path / "raw.bin"), 5).collect()}
    assert {k: v[0] for k, v in back.items()} == {(q, r): i for q, r, i, _ in rows(found)}
    top = tmp_path / "sift1M"
    for name, table, key in (("base", base, "vec_id"), ("learn", base, "vec_id"), ("query", queries, "qid")):
        vecs.write(table, str(top / f"sift_{name}.fvecs"), key)
    data = named.load(spark, str(tmp_path), "sift1M", 100)
    assert (data.base.count(), data.train.count(), data.query.count(), data.truth) == (100, 900, 20, None)
    assert (top / "sift_base.fvecs.100.parquet").exists() and sum(b.count() for b in data.blocks(7)) == 100
    with pytest.raises(ValueError):
        named.load(spark, str(tmp_path), "unknown")
    made = named.synthetic(spark, 8, 10, 200, 5, k=3)
    assert made.truth.count() == 15


def test_table_function(spark, cloud):
    base, queries, _ = cloud
    sql.register_knn(spark, base.filter("vec_id < 200"), 3)
    queries.createOrReplaceTempView("asking")
    got = spark.sql("SELECT a.qid, n.rank, n.vec_id, n.distance FROM asking a, LATERAL knn(a.qid, a.embedding) n")
    assert rows(got) == rows(flat.knn(queries, base.filter("vec_id < 200"), 3))


def test_exploring_by_bounds():
    ran = []

    def run(p):
        ran.append(p)
        return min(1.0, p["a"] / 4), p["a"] + p["b"]

    done = tuning.explore({"a": [1, 2, 4, 8], "b": [0, 1]}, run)
    assert max(d["performance"] for d in done) == 1.0 and len(ran) < 8
    with pytest.raises(ValueError):
        tuning.explore({"a": [1, 2, 3]}, lambda p: (p["a"] / 9, p["a"]), limit=2)
    timer = tuning.RepeatTimer(3, 1).run(lambda: None)
    assert len(timer.times) == 3 and timer.least() <= timer.mean()


def test_too_many_centroids_are_refused(spark, monkeypatch):
    from tessera.operators import binary

    monkeypatch.setattr(binary, "BLOCK_ROWS", 2)
    c = spark.createDataFrame([(i, [i]) for i in range(3)], "list_id int, words array<long>")
    with pytest.raises(ValueError):
        binary.assign(c.select(F.col("list_id").cast("long").alias("vec_id"), "words"), c)


def test_capped_probes(cloud):
    base, queries, _ = cloud
    index = IvfIndex.train(base, 8, params=kmeans.KMeansParams(niter=2)).add(base)
    probes = maintain.capped_probes(index.coarse(queries, 8), index.list_sizes(), 200)
    assert rows(index.search(queries, 4, 8, max_codes=200)) == rows(index.search(queries, 4, probes=probes))
