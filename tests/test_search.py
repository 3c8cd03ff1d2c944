"""Properties of the searches: lossless pruning, sound skips, stores, upkeep, graphs, streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import flat, graph, kmeans, multi, quantize, topk, transform
from tessera.operators.ivf import OPT_LEVELS, IvfIndex, opt_level
from tessera.plans import cli, factory, tuning
from tessera.sources import generate, results, vecs
from tessera.streaming.window import SlidingIndex


@pytest.fixture(scope="module")
def blobs(spark):
    """(base, queries): 40 clusters in 6 dimensions, with repeated vectors."""
    draw = np.random.Generator(np.random.PCG64(5))
    x = (draw.normal(size=(40, 6))[draw.integers(0, 40, 1200)] * 4 + draw.normal(size=(1200, 6)) * 0.3).round(3)
    x[100:110] = x[90]
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").cache()
    queries = spark.createDataFrame([(i, (x[i * 13] + 0.05).tolist()) for i in range(25)] + [(25, x[90].tolist())], "qid long, embedding array<double>").cache()
    return base, queries


def rows(df):
    return sorted(map(tuple, df.select("qid", "rank", "vec_id", "distance").collect()))


@pytest.mark.parametrize("opt", sorted(OPT_LEVELS))
@pytest.mark.parametrize("nprobe", [3, 20])
def test_pruning_loses_nothing(blobs, opt, nprobe):
    base, queries = blobs
    index = IvfIndex.train(base, 20, opt=opt, params=kmeans.KMeansParams(niter=5)).add(base)
    plain = IvfIndex.from_centroids(index.centroids, opt=0).add(base)
    assert rows(index.search(queries, 7, nprobe)) == rows(plain.search(queries, 7, nprobe))
    s = index.statistics(queries, 7, nprobe).first()
    assert s["computed"] + s["skip_tri"] + s["skip_tri_large"] + s["skip_l2"] + s["skip_ip"] == s["total"]
    if opt == "OPT_ALL":
        assert s["computed"] < s["total"] / 2


def test_full_probe_is_exact(blobs):
    base, queries = blobs
    index = IvfIndex.train(base, 20, params=kmeans.KMeansParams(niter=3)).add(base)
    exact = flat.knn(queries, base, 9)
    assert rows(index.search(queries, 9, 20)) == rows(exact)
    recalls = [len(set(rows(index.search(queries, 9, n))) & set(rows(exact))) for n in (1, 4, 20)]
    assert recalls == sorted(recalls)


def test_brute_force(blobs):
    base, queries = blobs
    b = {r[0]: np.array(r[1]) for r in base.collect()}
    for qid, q in queries.collect():
        want = sorted((float(np.floor(((np.array(q) - v) ** 2).sum() * 1e6 + 0.5) / 1e6), i) for i, v in b.items())[:5]
        got = [(d, i) for _, _, i, d in rows(flat.knn(queries.filter(F.col("qid") == qid), base, 5))] if qid in (0, 25) else want
        assert got == want


def test_inner_product_pruning(spark):
    base = generate.gaussian(spark, 800, 5, seed=3, unit=True).cache()
    queries = base.filter("vec_id % 40 = 0").withColumnRenamed("vec_id", "qid")
    index = IvfIndex.train(base, 12, "ip", "OPT_TRIANGLE", params=kmeans.KMeansParams(niter=4, metric="ip")).add(base)
    assert rows(index.search(queries, 6, 12)) == rows(flat.knn(queries, base, 6, "ip"))
    with pytest.raises(ValueError):
        IvfIndex.train(base, 12, "ip", "OPT_ALL")


def test_more_wanted_than_there_are(spark, blobs):
    base, queries = blobs
    few = base.filter("vec_id < 4")
    index = IvfIndex.from_centroids(np.array([[0.0] * 6, [50.0] * 6]), opt=7).add(few)
    assert rows(index.search(queries, 10, 2)) == rows(flat.knn(queries, few, 10))
    assert topk.padded(index.search(queries, 10, 2), queries, 10).count() == 260
    assert IvfIndex.from_centroids(index.centroids).add(base.limit(0)).search(queries, 3, 2).count() == 0
    assert flat.knn(queries.limit(0), base, 3).count() == 0


def test_store_and_upkeep(spark, blobs, tmp_path):
    base, queries = blobs
    index = IvfIndex.train(base, 8, opt="OPT_ALL", params=kmeans.KMeansParams(niter=2)).add(base.filter("vec_id < 600"))
    index.save(str(tmp_path / "index"))
    back = IvfIndex.load(spark, str(tmp_path / "index"))
    assert (back.metric, back.opt, back.nlist) == ("l2", 7, 8)
    assert rows(back.search(queries, 5, 8)) == rows(index.search(queries, 5, 8))
    more = back.add(base.filter("vec_id >= 600"))
    assert rows(more.search(queries, 5, 8)) == rows(flat.knn(queries, base, 5))
    gone = base.filter("vec_id % 3 = 0").select("vec_id")
    assert rows(more.remove(gone).search(queries, 5, 8)) == rows(flat.knn(queries, base.filter("vec_id % 3 <> 0"), 5))
    moved = base.filter("vec_id < 50").withColumn("embedding", F.transform("embedding", lambda x: x + 1))
    assert rows(more.update(moved).search(queries, 5, 8)) == rows(flat.knn(queries, moved.union(base.filter("vec_id >= 50")), 5))
    half = IvfIndex.from_centroids(index.centroids).add(base.filter("vec_id < 600"))
    both = half.merge(half, 10_000)
    assert both.rows.count() == 1200 and both.list_sizes().agg(F.sum("n")).first()[0] == 1200


def test_names_of_rules():
    assert opt_level("OPT_ALL") == opt_level(7) == opt_level("7") == 7
    with pytest.raises(ValueError):
        opt_level(8)


def test_kmeans(spark, blobs):
    base, _ = blobs
    model = kmeans.train(base, 10, kmeans.KMeansParams(niter=6))
    objective = [h["objective"] for h in model.history]
    assert all(b <= a * (1 + 1e-9) or h["splits"] for a, b, h in zip(objective, objective[1:], model.history))
    assert kmeans.two_level(base, 2, 3, kmeans.KMeansParams(niter=2)).shape == (6, 6)
    assert kmeans.progressive(base, 4, [2], kmeans.KMeansParams(niter=2)).centroids.shape == (4, 6)
    c, mass = np.array([[1.0, 1.0], [5.0, 5.0]]), np.array([10.0, 0.0])
    assert kmeans.split_empty(c, mass) == 1 and not np.array_equal(c[0], c[1])
    x = np.concatenate([np.full(5, 1.0), np.full(3, 4.0), np.full(2, 9.0)])
    assert kmeans.one_dimensional(x, 3).tolist() == [1.0, 4.0, 9.0]


def test_transforms(spark, blobs):
    base, _ = blobs
    turn = transform.rotation(6)
    back = turn.reverse(turn.apply(base)).withColumnRenamed("embedding", "b").join(base, "vec_id")
    assert back.filter(F.exists(F.zip_with("b", "embedding", lambda x, y: F.abs(x - y) > 1e-9), lambda x: x)).count() == 0
    white = np.array([r[1] for r in transform.pca(base, 3, whiten=-0.5).apply(base).collect()])
    assert np.allclose(np.cov(white.T, bias=True), np.eye(3), atol=1e-6)


@pytest.mark.parametrize("text", ["Flat", "IVF8,Flat", "PCA4,Flat", "RR,IVF8,Flat", "SQ8", "SQfp16", "PQ3x6,RFlat", "IVF4,PQ2x6", "OPQ2,PQ2x5", "RQ2x6", "LSQ2x4", "ITQ,LSH", "LSH", "HNSW12", "IDMap,L2norm,Centering,Pad8,Flat"])
def test_descriptions(spark, blobs, text):
    base, queries = blobs
    index = factory.build(text).train(base).add(base).set("nprobe=8,k_factor=10")
    found = index.search(queries, 5)
    assert found.count() == 26 * 5
    if text in ("Flat", "IVF8,Flat", "RR,IVF8,Flat"):
        assert [r[:3] for r in rows(found)][-5:] == [r[:3] for r in rows(flat.knn(queries, base, 5))][-5:]


def test_bad_descriptions():
    for text in ("", "Nonsense", "IVF8,LSH"):
        with pytest.raises(ValueError):
            factory.build(text)
    with pytest.raises(ValueError):
        factory.build("Flat").set("speed=3")


@pytest.mark.parametrize("tri_ef", [0, 60])
def test_graph_recall(spark, blobs, tmp_path, tri_ef):
    base, queries = blobs
    g = graph.build(base, 12, 80, block_rows=400).cache()
    truth, found = rows(flat.knn(queries, base, 10)), rows(graph.search(g, queries, 10, ef=60, tri_ef=tri_ef))
    near = {q: max(d for x, _, _, d in truth if x == q) for q in range(26)}
    assert sum(d <= near[q] for q, _, _, d in found) / len(truth) > 0.95
    if not tri_ef:
        graph.save(g, str(tmp_path / "g"))
        assert rows(graph.search(graph.load(spark, str(tmp_path / "g")), queries, 10, ef=60)) == found
    gone = base.filter("vec_id % 2 = 0").select("vec_id")
    assert all(i % 2 for _, _, i, _ in rows(graph.search(g, queries, 10, ef=60, deleted=gone)))


def test_neighbour_descent(spark, blobs):
    base, _ = blobs
    few = base.filter("vec_id < 300").cache()
    found = graph.descend(few, 8, rounds=5)
    truth = flat.knn(few.withColumnRenamed("vec_id", "qid"), few, 9).filter("qid <> vec_id").groupBy("qid").agg(F.max("distance").alias("edge"))
    share = found.join(truth, F.col("vec_id") == F.col("qid")).agg(F.avg((F.col("distance") <= F.col("edge") + 1e-6).cast("double"))).first()[0]
    assert share > 0.9


@pytest.mark.parametrize("block_rows", [200, 4096])
def test_neighbour_descent_finds_most(spark, block_rows):
    """Recall on vectors without structure, in several blocks and in one."""
    draw = np.random.default_rng(1).normal(size=(1500, 32))
    base = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(draw)], "vec_id long, embedding array<double>")
    found = {(r[0], r[2]) for r in graph.descend(base, 10, block_rows=block_rows).collect()}
    d = ((draw[:, None] - draw[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    true = {(i, int(j)) for i, row in enumerate(d.argsort(axis=1)[:, :10]) for j in row}
    assert len(found & true) >= 0.9 * len(true) and len(found) == len(true)
    assert block_rows == 200 or found == true


@pytest.mark.parametrize("ending", ["fvecs", "ivecs", "bvecs"])
def test_vector_files(spark, tmp_path, ending):
    data = [(i, [float((i * j) % 200) for j in range(1, 6)]) for i in range(37)]
    path = str(tmp_path / f"x.{ending}")
    assert vecs.write(spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3), path) == 37
    assert vecs.info(spark, path) == (37, 5)
    assert sorted(map(tuple, vecs.read(spark, path).collect())) == data
    assert [r[0] for r in vecs.read(spark, path, 3, 5).orderBy("vec_id").collect()] == [2, 3, 4]
    with pytest.raises(ValueError):
        vecs.info(spark, str(tmp_path / "x.dat"))


def test_results_in_files(spark, blobs, tmp_path):
    base, queries = blobs
    found = flat.knn(queries, base, 4)
    results.write_text(found, str(tmp_path / "t"))
    results.write_parquet(found, str(tmp_path / "p"))
    assert rows(results.read_text(spark, str(tmp_path / "t"))) == rows(results.read_parquet(spark, str(tmp_path / "p"))) == rows(found)


def test_command_line(spark, blobs, tmp_path):
    base, queries = blobs
    vecs.write(base.limit(400), str(tmp_path / "d/origin/d_base.fvecs")), vecs.write(queries, str(tmp_path / "d/origin/d_query.fvecs"), "qid")
    common = ["--benchmarks_path", str(tmp_path), "--dataset", "d", "--k", "5", "--nlist", "6", "--cache"]
    assert cli.run(spark, [*common, "--dataset_info"]).first()[:] == (400, 26, 6)
    log = cli.run(spark, [*common, "--nprobes", "1", "0", "--opt_levels", "OPT_TRIANGLE", "OPT_ALL", "--csv", str(tmp_path / "log")])
    assert [r["recall"] for r in log.filter("nprobe = 6").collect()] == [1.0, 1.0]
    assert results.read_metrics(spark, str(tmp_path / "log"), tuning.LOG).count() == 4
    # an index with more rules serves for fewer
    assert cli.run(spark, [*common, "--train_only", "--opt_levels", "OPT_TRIANGLE"]) is None
    assert len(list((tmp_path / "d/index").iterdir())) == 1
    with pytest.raises(ValueError):
        cli.run(spark, [*common, "--early_stop", "--ratios", "0.5"])


def test_exploring():
    done = tuning.explore({"nprobe": tuning.nprobe_ladder(16)}, lambda p: (min(1.0, p["nprobe"] / 4), p["nprobe"]))
    assert [d["nprobe"] for d in done] == [1, 2, 4]


def test_sliding_window(spark, blobs, tmp_path):
    base, queries = blobs
    index = IvfIndex.train(base, 6, params=kmeans.KMeansParams(niter=2))
    sliding = SlidingIndex(spark, index, str(tmp_path / "slices"))
    for i in range(4):
        sliding.append(base.filter(f"vec_id div 300 = {i}"), i)
    assert rows(sliding.window(2).search(queries, 5, 6)) == rows(flat.knn(queries, base.filter("vec_id >= 600"), 5))
    assert sliding.expire(2) == [0, 1] and sliding.slices() == [2, 3]


def test_stream_of_vectors(spark, blobs, tmp_path):
    base, queries = blobs
    base.filter("vec_id < 500").repartition(2).write.parquet(str(tmp_path / "in"))
    sliding = SlidingIndex(spark, IvfIndex.train(base, 6, params=kmeans.KMeansParams(niter=2)), str(tmp_path / "out"))
    stream = spark.readStream.schema(base.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sliding.stream(stream, str(tmp_path / "check")).awaitTermination()
    assert len(sliding.slices()) == 2
    assert rows(sliding.window(9).search(queries, 5, 6)) == rows(flat.knn(queries, base.filter("vec_id < 500"), 5))


def test_codecs(spark):
    draw = np.random.Generator(np.random.PCG64(2))
    x = draw.normal(size=(500, 8))
    errors = []
    for q in (quantize.ProductQuantizer.train(x, 2, 4), quantize.ProductQuantizer.train(x, 4, 6), quantize.HalfFloat()):
        errors.append(((q.decode(q.encode(x)) - x) ** 2).sum(axis=1).mean())
    assert errors == sorted(errors, reverse=True)
    pq = quantize.ProductQuantizer.train(x, 4, 4)
    codes = pq.encode(x)
    assert np.allclose(pq.distances(x[:3], codes), ((x[:3, None] - pq.decode(codes)[None]) ** 2).sum(axis=2))
    assert np.isinf(pq.polysemous(x[:3], codes, 2)).any()
    r1, r4 = (quantize.ResidualQuantizer(quantize.ResidualQuantizer.train(x, 3, 4).books, b) for b in (1, 4))
    assert ((r4.decode(r4.encode(x)) - x) ** 2).sum() <= ((r1.decode(r1.encode(x)) - x) ** 2).sum()
    codes = quantize.Lattice(2, 9).encode(x)
    assert ((codes.reshape(-1, 4) ** 2).sum(axis=1) <= 9).all()


def test_axis_rule_is_sound():
    draw = np.random.Generator(np.random.PCG64(8))
    skipped = 0
    for _ in range(40):
        c, x = draw.normal(size=4), draw.normal(size=(300, 4))
        q = x[0] + draw.normal(size=4) * 0.2
        bound = float(np.sort(np.linalg.norm(x - q, axis=1))[5])
        skip = multi.axis_skips(x, q, c, bound, 4)
        assert (np.linalg.norm(x[skip] - q, axis=1) > bound).all()
        skipped += skip.sum()
    assert skipped > 0


def test_spectral_bits():
    x = np.random.Generator(np.random.PCG64(3)).normal(size=(400, 6))
    h = quantize.SpectralHash.train(x, 4, 1.0)
    codes = h.encode(x)
    assert set(np.unique(codes)) == {0, 1} and (h.distances(x[:5], codes)[np.arange(5), np.arange(5)] == 0).all()
