"""Registered queries over the vector operators, and the SQL each is held against.

Searches take as queries every row whose id is divisible by 20, against all rows. Distances are
rounded to six decimals before ranking, ties go to the lesser id.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.functions.vectors import METRICS
from tessera.operators import batch, binary, evaluate, flat, graph, kmeans, maintain, multi, quantize, select, topk, transform
from tessera.operators.ivf import SUBNN_IP, SUBNN_L2, TRI, IvfIndex
from tessera.sources.shared import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
K = 10


def _register(sql: str | None = None, name: str | None = None):
    def keep(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return keep


# --- inputs -------------------------------------------------------------------------------


def base(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet")


def positive(spark: SparkSession, sf: str) -> DataFrame:
    return base(spark, sf).select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double")) + 0.001).alias("embedding"))


def whole(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of whole numbers, as bytes have them."""
    return base(spark, sf).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 127 + 128).cast("int")).alias("embedding"))


def parts(spark: SparkSession, sf: str) -> DataFrame:
    """A base of low dimension, where radii prune: size and price of a part, in fixed units."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    return part.select(F.col("p_partkey").alias("vec_id"), F.array(F.col("p_size") / F.lit(10.0), F.col("p_retailprice") / F.lit(100.0)).alias("embedding"))


def asked(rows: DataFrame) -> DataFrame:
    return rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")


def label_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """list_id, centroid: the mean vector of each label."""
    each = base(spark, sf).select("label", F.posexplode("embedding").alias("pos", "v"))
    mean = each.groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return mean.groupBy(F.col("label").alias("list_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("centroid"))


def label_index(spark: SparkSession, sf: str, opt: int = 0) -> IvfIndex:
    rows = sorted(label_centroids(spark, sf).collect())
    return IvfIndex.from_centroids(np.array([r["centroid"] for r in rows]), opt=opt).add(base(spark, sf))


def trained_index(rows: DataFrame, opt: int, nlist: int = 16, metric: str = "l2") -> IvfIndex:
    return IvfIndex.train(rows, nlist, metric, opt, params=kmeans.KMeansParams(niter=8, metric=metric)).add(rows)


# --- SQL ----------------------------------------------------------------------------------


def _sum(a: str, b: str, term: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: {term}))"


_X, _Y = "z[1]::DOUBLE", "z[2]::DOUBLE"
SQL_METRICS = {
    "l2": lambda a, b: _sum(a, b, f"({_X} - {_Y}) * ({_X} - {_Y})"),
    "ip": lambda a, b: _sum(a, b, f"{_X} * {_Y}"),
    "cosine": lambda a, b: f"{_sum(a, b, f'{_X} * {_Y}')} / sqrt({_sum(a, a, f'{_X} * {_Y}')} * {_sum(b, b, f'{_X} * {_Y}')})",
    "ip_distance": lambda a, b: f"1 - {_sum(a, b, f'{_X} * {_Y}')}",
    "cosine_distance": lambda a, b: f"1 - {_sum(a, b, f'{_X} * {_Y}')} / sqrt({_sum(a, a, f'{_X} * {_Y}')} * {_sum(b, b, f'{_X} * {_Y}')})",
    "l2_whole": lambda a, b: _sum(a, b, f"({_X} - {_Y}) * ({_X} - {_Y})"),
    "l1": lambda a, b: _sum(a, b, f"abs({_X} - {_Y})"),
    "linf": lambda a, b: f"list_max(list_transform(list_zip({a}, {b}), lambda z: abs({_X} - {_Y})))",
    "lp": lambda a, b: _sum(a, b, f"pow(abs({_X} - {_Y}), 3)"),
    "canberra": lambda a, b: _sum(a, b, f"coalesce(abs({_X} - {_Y}) / nullif(abs({_X}) + abs({_Y}), 0), 0)"),
    "bray_curtis": lambda a, b: f"{_sum(a, b, f'abs({_X} - {_Y})')} / {_sum(a, b, f'abs({_X} + {_Y})')}",
    "jensen_shannon": lambda a, b: _sum(a, b, f"-({_X}) * ln(({_X} + {_Y}) / 2 / ({_X})) - ({_Y}) * ln(({_X} + {_Y}) / 2 / ({_Y}))") + " / 2",
    "jaccard": lambda a, b: f"{_sum(a, b, f'least({_X}, {_Y})')} / {_sum(a, b, f'greatest({_X}, {_Y})')}",
}
B64 = "SELECT vec_id, embedding AS e FROM embeddings"
POS = "SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE) + 0.001) AS e FROM embeddings"
WHOLE = "SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 127 + 128)) AS e FROM embeddings"
PART = "SELECT p_partkey AS vec_id, [p_size / 10.0::DOUBLE, p_retailprice / 100.0::DOUBLE] AS e FROM part"


def _r(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def _top(source: str, k: int, greater: bool = False, out: str = "qid, rank, vec_id, distance") -> str:
    return f"SELECT {out} FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance{' DESC' if greater else ''}, vec_id)::INTEGER AS rank FROM ({source})) WHERE rank <= {k}"


def _pairs(b: str = B64, metric: str = "l2", where: str = "true") -> str:
    return f"SELECT q.vec_id AS qid, b.vec_id, {_r(SQL_METRICS[metric]('q.e', 'b.e'))} AS distance FROM ({b}) q, ({b}) b WHERE q.vec_id % 20 = 0 AND {where}"


def _knn(b: str = B64, metric: str = "l2", k: int = K, where: str = "true") -> str:
    return _top(_pairs(b, metric, where), k, METRICS[metric][1])


_CENTROIDS = """SELECT label AS list_id, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(v::DOUBLE) AS m FROM
(SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos) GROUP BY label"""
_ASSIGNED = f"""SELECT vec_id, e, list_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, list_id) AS n FROM
(SELECT b.vec_id, b.e, c.list_id, {_r(SQL_METRICS['l2']('b.e', 'c.c'))} AS distance FROM ({B64}) b, ({_CENTROIDS}) c)) WHERE n = 1"""
_PROBES = f"""SELECT qid, rank AS probe_rank, list_id, distance, e FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, list_id)::INTEGER AS rank FROM
(SELECT q.vec_id AS qid, q.e, c.list_id, {_r(SQL_METRICS['l2']('q.e', 'c.c'))} AS distance FROM ({B64}) q, ({_CENTROIDS}) c WHERE q.vec_id % 20 = 0))"""


def _ivf_pairs(nprobe: int, metric: str = "l2") -> str:
    return f"""SELECT p.qid, a.vec_id, {_r(SQL_METRICS[metric]('p.e', 'a.e'))} AS distance FROM ({_PROBES}) p JOIN ({_ASSIGNED}) a USING (list_id) WHERE p.probe_rank <= {nprobe}"""


# --- exact search -------------------------------------------------------------------------

for _m in METRICS:
    _source, _sql = (positive, POS) if _m in ("jensen_shannon", "jaccard") else (whole, WHOLE) if _m == "l2_whole" else (base, B64)

    def _flat(spark, sf, m=_m, source=_source):
        rows = source(spark, sf)
        return flat.knn(asked(rows), rows, K, m)

    _register(_knn(_sql, _m), f"flat_knn_{_m}")(_flat)

    def _pairs_of(spark, sf, m=_m, source=_source):
        rows = source(spark, sf)
        pairs = rows.select(F.col("vec_id").alias("i"), (F.col("vec_id") + 1).alias("j"))
        return flat.indexed_pairs(pairs, rows, rows, m).withColumn("distance", topk.rounded(F.col("distance")))

    _register(f"SELECT a.vec_id AS i, b.vec_id AS j, {_r(SQL_METRICS[_m]('a.e', 'b.e'))} AS distance FROM ({_sql}) a JOIN ({_sql}) b ON b.vec_id = a.vec_id + 1", f"dist_{_m}")(_pairs_of)


@_register(_knn(PART))
def flat_knn_parts(spark, sf):
    rows = parts(spark, sf)
    return flat.knn(asked(rows), rows, K)


@_register(f"SELECT * FROM ({_pairs()}) WHERE distance < 1.2")
def range_l2(spark, sf):
    return flat.range_search(asked(base(spark, sf)), base(spark, sf), 1.2)


@_register(f"SELECT * FROM ({_pairs(metric='ip')}) WHERE distance > 0.4")
def range_ip(spark, sf):
    return flat.range_search(asked(base(spark, sf)), base(spark, sf), 0.4, "ip")


@_register(f"WITH f AS (SELECT * FROM ({_pairs()}) WHERE distance < 1.2) SELECT q.qid, coalesce(sum(coalesce(n, 0)) OVER (ORDER BY q.qid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lims FROM (SELECT vec_id AS qid FROM embeddings WHERE vec_id % 20 = 0) q LEFT JOIN (SELECT qid, count(*) AS n FROM f GROUP BY qid) USING (qid)")
def range_limits(spark, sf):
    q = asked(base(spark, sf))
    return flat.range_limits(flat.range_search(q, base(spark, sf), 1.2), q)


@_register(f"WITH f AS (SELECT * FROM ({_pairs()}) WHERE distance < 1.2), e AS (SELECT count(*) AS n, max(distance) AS edge FROM (SELECT distance FROM f ORDER BY distance LIMIT 101)) SELECT qid, vec_id, distance FROM f, e WHERE n <= 100 OR distance < edge")
def range_capped(spark, sf):
    return flat.capped_range_search(asked(base(spark, sf)), base(spark, sf), 1.2, 100)


@_register(_top(f"SELECT * FROM ({_pairs()}) WHERE abs(qid - vec_id) % 7 = 3", K))
def knn_by_listed_ids(spark, sf):
    rows = base(spark, sf)
    q = asked(rows)
    most = rows.agg(F.max("vec_id")).first()[0]
    lists = q.withColumn("ids", F.filter(F.sequence(F.lit(0).cast("long"), F.lit(most)), lambda x: F.pmod(F.abs(F.col("qid") - x), F.lit(7)) == 3))
    return flat.knn_by_listed_ids(lists, rows, K)


@_register(f"SELECT qid, rank, vec_id, distance FROM ({_knn(k=20)}) WHERE distance < 0.9 OR rank <= 3")
def epsilon_search(spark, sf):
    return flat.epsilon_search(asked(base(spark, sf)), base(spark, sf), 0.9, 3, 20)


@_register(_top(f"SELECT qid, vec_id // 5 AS vec_id, min(distance) AS distance FROM ({_pairs()}) GROUP BY ALL", K, out="qid, rank, vec_id AS doc_id, distance"))
def nearest_documents(spark, sf):
    rows = base(spark, sf).withColumn("doc_id", F.expr("vec_id div 5"))
    return flat.nearest_documents(asked(rows), rows, K)


@_register(_top(f"SELECT p.qid, p.vec_id, p.distance FROM ({_pairs()}) p JOIN ({_knn(metric='l1', k=30)}) c USING (qid, vec_id)", K))
def refine(spark, sf):
    rows = base(spark, sf)
    return flat.refine(flat.knn(asked(rows), rows, 30, "l1"), asked(rows), rows, K)


@_register(_knn())
def merge_shards(spark, sf):
    rows = base(spark, sf)
    return topk.merge([flat.knn(asked(rows), rows.filter(f"vec_id % 4 = {i}"), K) for i in range(4)], K).select("qid", "rank", "vec_id", "distance")


@_register(f"SELECT qid, vec_id, distance FROM ({_knn(k=1)})")
def nearest_one(spark, sf):
    rows = base(spark, sf)
    return topk.nearest(flat.knn(asked(rows), rows, 3))


@_register(f"SELECT q.vec_id AS qid, r.rank::INTEGER AS rank, coalesce(k.vec_id, -1) AS vec_id, coalesce(k.distance, 3.4028234663852886e38) AS distance FROM (SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0) q, range(1, 11) r(rank) LEFT JOIN ({_top(f'SELECT * FROM ({_pairs()}) WHERE distance < 0.8', K)}) k ON k.qid = q.vec_id AND k.rank = r.rank")
def padded_results(spark, sf):
    rows = base(spark, sf)
    return topk.padded(flat.knn(asked(rows), rows, K).filter("distance < 0.8"), asked(rows), K)


@_register("SELECT vec_id AS qid, true AS in_order FROM embeddings WHERE vec_id % 20 = 0")
def results_in_order(spark, sf):
    return topk.is_sorted(flat.knn(asked(base(spark, sf)), base(spark, sf), K))


@_register(f"SELECT k.qid, k.rank, k.vec_id, k.distance, list_transform(b.embedding, lambda x: x::DOUBLE) AS embedding FROM ({_knn()}) k JOIN embeddings b USING (vec_id)")
def search_and_reconstruct(spark, sf):
    rows = base(spark, sf)
    return flat.with_vectors(flat.knn(asked(rows), rows, K), rows).withColumn("embedding", F.col("embedding").cast("array<double>"))


_SELECTORS = {
    "range": (select.Between(100, 300), "b.vec_id >= 100 AND b.vec_id < 300"),
    "array": (select.OneOf(tuple(range(3, 400, 11))), "b.vec_id % 11 = 3 AND b.vec_id < 400"),
    "bitmap": (select.Bitmap(bytes([0b10010001] * 32)), "b.vec_id < 256 AND b.vec_id % 8 IN (0, 4, 7)"),
    "not": (~select.Between(100, 300), "NOT (b.vec_id >= 100 AND b.vec_id < 300)"),
    "and": (select.Between(50, 300) & ~select.OneOf((60, 80, 100)), "b.vec_id BETWEEN 50 AND 299 AND b.vec_id NOT IN (60, 80, 100)"),
    "or": (select.Between(0, 100) | select.Between(400, 450), "b.vec_id < 100 OR b.vec_id BETWEEN 400 AND 449"),
    "xor": (select.Between(0, 200) ^ select.Between(100, 300), "(b.vec_id < 200) <> (b.vec_id BETWEEN 100 AND 299)"),
    "all": (select.Everything(), "true"),
    "predicate": (select.Predicate(lambda c: c % 3 == 1), "b.vec_id % 3 = 1"),
}
for _n, (_selector, _where) in _SELECTORS.items():

    def _filtered(spark, sf, selector=_selector):
        rows = base(spark, sf)
        return flat.knn(asked(rows), selector.apply(rows), K)

    _register(_knn(where=f"({_where})"), f"knn_filtered_{_n}")(_filtered)


@_register(_knn(where="b.vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def knn_filtered_table(spark, sf):
    rows = base(spark, sf)
    ids = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").select(F.col("doc_id").alias("vec_id"))
    return flat.knn(asked(rows), select.in_table(rows, ids), K)


@_register(_knn(where="b.vec_id + 1000 BETWEEN 1100 AND 1199"))
def knn_filtered_translated(spark, sf):
    rows = base(spark, sf)
    id_map = rows.select("vec_id", (F.col("vec_id") + 1000).alias("external_id"))
    return flat.knn(asked(rows), select.translated(rows, id_map, select.Between(1100, 1200)), K)


# --- vector functions ---------------------------------------------------------------------


@_register(f"""SELECT vec_id, {_r("sqrt(" + SQL_METRICS['ip']('e', 'e') + ")")} AS norm, {_r(SQL_METRICS['ip']('e', 'e'))} AS squared,
{_r("list_sum(list_transform(e, lambda x: x::DOUBLE + 2.5))")} AS shifted, {_r(_sum('e', 'list_reverse(e)', f'({_X} - {_Y}) + ({_X} + {_Y}) + ({_X} + 3 * {_Y})'))} AS mixed,
list_transform(list_sort(e)[1:3], lambda x: {_r('x::DOUBLE')}) AS least, list_transform(list_reverse_sort(e)[1:3], lambda x: {_r('x::DOUBLE')}) AS greatest,
list_sum(list_transform(e, lambda x: CASE WHEN x >= 0 THEN 1 ELSE 0 END))::BIGINT AS ones,
{_r("list_sum(list_transform(e, lambda x: CASE WHEN x >= 0 THEN 1.0 ELSE -1.0 END)::DOUBLE[])")} AS signs,
[{_r('e[3]::DOUBLE')}, 0.0, {_r('e[1]::DOUBLE')}] AS shuffled FROM ({B64})""")
def vector_functions(spark, sf):
    e, back = F.col("embedding"), F.reverse("embedding")
    r = topk.rounded
    mixed = V.add(V.add(V.subtract(e, back), V.add(e, back)), V.multiply_add(e, 3.0, back))
    return base(spark, sf).select(
        "vec_id", r(V.norm(e)).alias("norm"), r(V.squared_norm(e)).alias("squared"), r(V.total(V.add_scalar(e, 2.5))).alias("shifted"), r(V.total(mixed)).alias("mixed"),
        F.transform(V.k_least(e, 3), r).alias("least"), F.transform(V.k_greatest(e, 3), r).alias("greatest"),
        F.aggregate(V.sign_bits(e), F.lit(0).cast("long"), lambda s, x: s + x).alias("ones"), r(V.total(V.bits_to_floats(V.sign_bits(e)))).alias("signs"),
        F.transform(V.shuffled(e, [2, -1, 0]), r).alias("shuffled"),
    )


@_register(f"SELECT vec_id, list_transform(e, lambda x: {_r('x::DOUBLE / sqrt(n)')}) AS embedding FROM (SELECT vec_id, e, {SQL_METRICS['ip']('e', 'e')} AS n FROM ({POS}))")
def normalize(spark, sf):
    return transform.normalised(positive(spark, sf)).select("vec_id", F.transform("embedding", topk.rounded).alias("embedding"))


@_register(f"SELECT a.vec_id AS i, b.vec_id AS j, {_r(SQL_METRICS['l2']('a.e', 'b.e'))} AS distance, {_r('abs(' + SQL_METRICS['l1']('a.e', 'b.e') + ' - ' + SQL_METRICS['l2']('a.e', 'b.e') + ') / ' + SQL_METRICS['l2']('a.e', 'b.e'))} AS error FROM ({B64}) a JOIN ({B64}) b ON b.vec_id = a.vec_id + 1")
def l2_from_inner_product(spark, sf):
    a = base(spark, sf).select(F.col("vec_id").alias("i"), F.col("embedding").alias("a"))
    b = base(spark, sf).select((F.col("vec_id") - 1).alias("i"), F.col("vec_id").alias("j"), F.col("embedding").alias("b"))
    x, y = F.col("a"), F.col("b")
    joined = a.join(b, "i")
    return joined.select("i", "j", topk.rounded(V.l2_from_inner_product(V.inner_product(x, y), x, y)).alias("distance"), topk.rounded(V.relative_error(V.l1(x, y), V.squared_l2(x, y))).alias("error"))


@_register(f"SELECT a.vec_id AS i, {_r(SQL_METRICS['l2']('a.e[1:16]', 'b.e[1:16]') + ' + ' + SQL_METRICS['l2']('a.e[17:64]', 'b.e[17:64]'))} AS distance FROM ({B64}) a JOIN ({B64}) b ON b.vec_id = a.vec_id + 1")
def split_vectors(spark, sf):
    a = base(spark, sf).select(F.col("vec_id").alias("i"), F.col("embedding").alias("a"))
    b = base(spark, sf).select((F.col("vec_id") - 1).alias("i"), F.col("embedding").alias("b"))
    return a.join(b, "i").select("i", topk.rounded(maintain.split_dimensions(a, [16, 48], V.squared_l2)).alias("distance"))


# --- inverted file ------------------------------------------------------------------------


@_register(f"SELECT list_id, list_transform(c, lambda x: {_r('x')}) AS centroid FROM ({_CENTROIDS})")
def centroids_by_label(spark, sf):
    return label_centroids(spark, sf).select("list_id", F.transform("centroid", topk.rounded).alias("centroid"))


@_register(f"SELECT vec_id, list_id, distance FROM ({_ASSIGNED})")
def assign_nearest(spark, sf):
    return flat.assign(base(spark, sf), label_centroids(spark, sf)).select("vec_id", "list_id", "distance")


@_register(f"SELECT qid, probe_rank, list_id, distance FROM ({_PROBES}) WHERE probe_rank <= 3")
def probe_top3(spark, sf):
    return label_index(spark, sf).coarse(asked(base(spark, sf)), 3)


@_register(f"SELECT list_id, count(*) AS n FROM ({_ASSIGNED}) GROUP BY list_id")
def list_sizes(spark, sf):
    return maintain.list_sizes(label_index(spark, sf).rows)


@_register(f"SELECT length(bin(n)) AS bits, count(*) AS lists FROM (SELECT count(*) AS n FROM ({_ASSIGNED}) GROUP BY list_id) GROUP BY 1")
def list_size_histogram(spark, sf):
    return maintain.size_histogram(label_index(spark, sf).rows)


@_register(f"SELECT {_r('count(*) * sum(n * n) / (sum(n) * sum(n))')} AS imbalance FROM (SELECT count(*)::DOUBLE AS n FROM ({_ASSIGNED}) GROUP BY list_id)")
def imbalance_factor(spark, sf):
    return maintain.imbalance(label_index(spark, sf).rows).select(topk.rounded(F.col("imbalance")).alias("imbalance"))


@_register(f"SELECT list_id, {_r('max(sqrt(distance))')} AS r_max FROM (SELECT b.list_id, {SQL_METRICS['l2']('b.e', 'c.c')} AS distance FROM ({_ASSIGNED}) b JOIN ({_CENTROIDS}) c USING (list_id)) GROUP BY list_id")
def max_radius(spark, sf):
    return maintain.max_radius(label_index(spark, sf).rows).select("list_id", topk.rounded(F.col("r_max")).alias("r_max"))


@_register(_top(_ivf_pairs(3), K))
def ivf_knn_nprobe3(spark, sf):
    return label_index(spark, sf).search(asked(base(spark, sf)), K, 3)


@_register(_knn())
def ivf_knn_full(spark, sf):
    return label_index(spark, sf).search(asked(base(spark, sf)), K, 100)


@_register(f"SELECT * FROM ({_ivf_pairs(3)}) WHERE distance < 1.2")
def ivf_range(spark, sf):
    return label_index(spark, sf).range_search(asked(base(spark, sf)), 1.2, 3)


@_register(_top(f"SELECT q.vec_id AS qid, a.vec_id, {_r(SQL_METRICS['l2']('q.e', 'a.e'))} AS distance FROM ({B64}) q JOIN ({_ASSIGNED}) a ON a.list_id = q.vec_id // 20 % 10 WHERE q.vec_id % 20 = 0", K))
def ivf_preassigned(spark, sf):
    q = asked(base(spark, sf))
    chosen = q.select("qid", F.expr("cast(qid div 20 % 10 as int)").alias("list_id"))
    return label_index(spark, sf).search(q, K, probes=chosen)


@_register(_top(f"SELECT p.qid, b.vec_id, {_r(SQL_METRICS['l2']('p.e', 'b.embedding'))} AS distance FROM ({_PROBES}) p JOIN embeddings b ON b.label = p.list_id WHERE p.probe_rank <= 3", K))
def ivf_add_preassigned(spark, sf):
    rows = base(spark, sf)
    lists = rows.select("vec_id", F.col("label").alias("list_id"))
    index = label_index(spark, sf)
    return index.reset().add(rows, lists).search(asked(rows), K, 3)


@_register(f"""WITH s AS (SELECT list_id, count(*) AS n FROM ({_ASSIGNED}) GROUP BY list_id), p AS (SELECT qid, probe_rank, list_id, coalesce(sum(coalesce(n, 0)) OVER (PARTITION BY qid ORDER BY probe_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({_PROBES}) LEFT JOIN s USING (list_id))
SELECT qid, probe_rank, list_id FROM p WHERE before < 150""")
def ivf_max_codes(spark, sf):
    index = label_index(spark, sf)
    return maintain.capped_probes(index.coarse(asked(base(spark, sf)), 100), index.list_sizes(), 150)


_RULES = {"none": 0, "tri_l2": TRI, "subnn_l2": SUBNN_L2, "subnn_ip": SUBNN_IP, "tri_subnn_l2": TRI | SUBNN_L2, "tri_subnn_ip": TRI | SUBNN_IP, "subnn_only": SUBNN_L2 | SUBNN_IP, "all": 7}
for _n, _opt in _RULES.items():

    def _pruned(spark, sf, opt=_opt):
        rows = parts(spark, sf)
        return trained_index(rows, opt).search(asked(rows), K, 16)

    _register(_knn(PART), f"ivf_{_n}")(_pruned)


@_register(_knn(metric="ip"))
def ivf_tri_ip(spark, sf):
    rows = base(spark, sf)
    return trained_index(rows, TRI, metric="ip").search(asked(rows), K, 16)


@_register("SELECT true AS most_found, true AS none_beyond")
def ivf_lossy(spark, sf):
    """A bound scaled to 0.7 finds most, and never more than there is."""
    rows = parts(spark, sf)
    index = trained_index(rows, TRI)
    recall = evaluate.recall_at_k(index.search(asked(rows), K, 16, ratio=0.7), flat.knn(asked(rows), rows, K), K)
    return recall.select((F.col("recall") >= 0.9).alias("most_found"), (F.col("recall") <= 1).alias("none_beyond"))


@_register("SELECT count(*) FILTER (p_partkey % 20 = 0) * count(*) AS total, true AS adds_up, true AS prunes FROM part")
def prune_statistics(spark, sf):
    """All pairs are candidates, and each is measured or skipped by one rule."""
    rows = parts(spark, sf)
    s = trained_index(rows, 7).statistics(asked(rows), K, 16)
    skipped = sum((F.col(c) for c in ("skip_tri", "skip_tri_large", "skip_l2", "skip_ip", "skip_cells")), F.lit(0))
    return s.select("total", (F.col("computed") + skipped == F.col("total")).alias("adds_up"), (F.col("pruning_speedup") > 1).alias("prunes"))


@_register(f"""WITH t AS (SELECT p.qid, sqrt(p.distance) AS d, a.vec_id, sqrt(a.distance) AS r FROM ({_PROBES}) p JOIN ({_ASSIGNED}) a USING (list_id))
SELECT qid, count(*) AS total, count(*) FILTER (r < d - 0.1) AS below, count(*) FILTER (r > d + 0.1) AS above FROM t GROUP BY qid""")
def prune_counts_tri(spark, sf):
    """What the triangle rule skips at a fixed bound of 0.1."""
    index = label_index(spark, sf)
    probes = index.coarse(asked(base(spark, sf)), 100).select("qid", "list_id", F.sqrt("distance").alias("d"))
    rows = flat.assign(base(spark, sf), label_centroids(spark, sf)).select("vec_id", "list_id", F.sqrt("distance").alias("r"))
    both = rows.join(probes, "list_id")
    return both.groupBy("qid").agg(F.count("*").alias("total"), F.sum((F.col("r") < F.col("d") - 0.1).cast("long")).alias("below"), F.sum((F.col("r") > F.col("d") + 0.1).cast("long")).alias("above"))


def _subnn_sql(order: str, value: str, k: int = 5) -> str:
    return f"""WITH a AS ({_ASSIGNED}), c AS ({_CENTROIDS}), x AS (SELECT vec_id, list_id, e, list_transform(list_zip(e, c.c), lambda z: {_X} - {_Y}) AS f FROM a JOIN c USING (list_id)),
p AS (SELECT x.vec_id, y.vec_id AS nbr_id, {_r(value)} AS val FROM x JOIN x y USING (list_id) WHERE x.vec_id <> y.vec_id)
SELECT vec_id, rank, nbr_id, val FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY val {order}, nbr_id)::INTEGER AS rank FROM p) WHERE rank <= {k}"""


for _n, _column, _order, _value in (
    ("l2", "near", "", "sqrt(" + SQL_METRICS["l2"]("x.e", "y.e") + ")"),
    ("cos_near", "cos_near", "DESC", SQL_METRICS["cosine"]("x.f", "y.f")),
    ("cos_far", "cos_far", "", SQL_METRICS["cosine"]("x.f", "y.f")),
):

    def _neighbours(spark, sf, column=_column):
        index = label_index(spark, sf)
        rows = IvfIndex(index.centroids, index.rows, sub_k=5).with_neighbours().rows
        each = rows.select("vec_id", F.posexplode(F.arrays_zip(F.col(f"{column}_ids").alias("i"), F.col(column).alias("v"))).alias("pos", "x"))
        return each.select("vec_id", (F.col("pos") + 1).alias("rank"), F.col("x.i").alias("nbr_id"), topk.rounded(F.col("x.v")).alias("val"))

    _register(_subnn_sql(_order, _value), f"subnn_{_n}")(_neighbours)


# --- k-means ------------------------------------------------------------------------------

_MD5 = "md5('6666:' || vec_id::VARCHAR), vec_id"


@_register(f"SELECT vec_id FROM embeddings ORDER BY {_MD5} LIMIT 16")
def kmeans_init(spark, sf):
    return kmeans.initial(base(spark, sf), 16).select("vec_id")


@_register(f"SELECT vec_id FROM embeddings ORDER BY {_MD5} LIMIT 256")
def kmeans_sample(spark, sf):
    return kmeans.training_sample(base(spark, sf), 8, 32).select("vec_id")


@_register(f"""WITH a AS (SELECT list_id, unnest(e) AS v, generate_subscripts(e, 1) AS pos FROM ({_ASSIGNED}))
SELECT list_id, list({_r('m')} ORDER BY pos) AS centroid FROM (SELECT list_id, pos, avg(v::DOUBLE) AS m FROM a GROUP BY ALL) GROUP BY list_id""")
def kmeans_step(spark, sf):
    """One Lloyd step from the label means."""
    rows = sorted(label_centroids(spark, sf).collect())
    new, _ = kmeans.step(base(spark, sf), np.array([r["centroid"] for r in rows]), kmeans.KMeansParams())
    return spark.createDataFrame([(i, [float(np.floor(x * 1e6 + 0.5) / 1e6) for x in c]) for i, c in enumerate(new)], "list_id int, centroid array<double>")


@_register("SELECT i::INTEGER AS iteration, true AS no_worse, true AS balanced FROM range(10) t(i)")
def kmeans_train(spark, sf):
    """The objective doesn't grow from one iteration to the next, unless a cluster was split, and the
    imbalance factor is at least 1 and at most the number of lists."""
    model = kmeans.train(base(spark, sf), 16, kmeans.KMeansParams(niter=10))
    h = model.history
    rows = [(i, i == 0 or x["objective"] <= h[i - 1]["objective"] * (1 + 1e-9) or h[i - 1]["splits"] > 0, 1 - 1e-9 <= x["imbalance"] <= 16) for i, x in enumerate(h)]
    return spark.createDataFrame([(i, bool(a), bool(b)) for i, a, b in rows], "iteration int, no_worse boolean, balanced boolean")


# --- upkeep -------------------------------------------------------------------------------


@_register("SELECT pos::INTEGER AS pos, count(*) AS n, " + ", ".join(f"{_r(f'{f}(v)')} AS {a}" for f, a in (("avg", "mean"), ("stddev_pop", "stddev"), ("min", "least"), ("max", "greatest"))) + ", 0::BIGINT AS n_nan FROM (SELECT generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY pos")
def matrix_stats(spark, sf):
    s = maintain.dimension_stats(base(spark, sf))
    return s.select("pos", "n", *[topk.rounded(F.col(c)).alias(c) for c in ("mean", "stddev", "least", "greatest")], "n_nan")


@_register(f"SELECT count(*) AS n, count(DISTINCT e) AS n_distinct, {_r('min(n)')} AS least_norm, {_r('max(n)')} AS greatest_norm, 0::BIGINT AS n_zero FROM (SELECT e, sqrt({SQL_METRICS['ip']('e', 'e')}) AS n FROM ({B64}))")
def matrix_summary(spark, sf):
    s = maintain.matrix_summary(base(spark, sf))
    return s.select("n", "n_distinct", topk.rounded(F.col("least_norm")).alias("least_norm"), topk.rounded(F.col("greatest_norm")).alias("greatest_norm"), "n_zero")


@_register("SELECT (pos - 1)::INTEGER AS pos, sum(CASE WHEN v >= 0 THEN 1 ELSE 0 END)::BIGINT AS ones FROM (SELECT generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS v FROM embeddings) GROUP BY pos")
def bit_histogram(spark, sf):
    return maintain.bit_histogram(binary.lsh_bits(base(spark, sf)))


_UP = "SELECT p_size AS list_id, p_partkey AS vec_id FROM part"
for _n, _make, _sql in (
    ("add_union", lambda r: maintain.union_with_offset(r, r, 0), f"{_UP} UNION ALL {_UP}"),
    ("merge_offset", lambda r: maintain.union_with_offset(r, r, 100000), f"{_UP} UNION ALL SELECT p_size AS list_id, p_partkey + 100000 AS vec_id FROM part"),
    ("hstack_lists", lambda r: maintain.stacked([r.filter("vec_id % 2 = 0"), r.filter("vec_id % 2 = 1")]), _UP),
    ("vstack_lists", lambda r: maintain.stacked_below([(r, 100), (r, 100)]), f"{_UP} UNION ALL SELECT p_size + 100 AS list_id, p_partkey AS vec_id FROM part"),
    ("slice_lists", lambda r: r.filter("list_id between 10 and 20"), f"SELECT * FROM ({_UP}) WHERE list_id BETWEEN 10 AND 20"),
    ("masked_lists", lambda r: maintain.masked(r.filter("list_id < 25"), r.withColumn("vec_id", F.col("vec_id") + 7)), f"SELECT list_id, CASE WHEN list_id < 25 THEN vec_id ELSE vec_id + 7 END AS vec_id FROM ({_UP})"),
    ("stop_lists", lambda r: maintain.without_long_lists(r, 40), f"SELECT * FROM ({_UP}) WHERE list_id IN (SELECT list_id FROM ({_UP}) GROUP BY list_id HAVING count(*) <= 40)"),
    ("remove_ids", lambda r: select.in_table(r, r.filter("vec_id % 3 = 0"), keep=False), f"SELECT * FROM ({_UP}) WHERE vec_id % 3 <> 0"),
    ("update_vectors", lambda r: maintain.replaced(r, r.filter("vec_id % 3 = 0").withColumn("list_id", F.col("list_id") + 1)), f"SELECT CASE WHEN vec_id % 3 = 0 THEN list_id + 1 ELSE list_id END AS list_id, vec_id FROM ({_UP})"),
    ("copy_subset", lambda r: r.filter("vec_id % 5 = 2"), f"SELECT * FROM ({_UP}) WHERE vec_id % 5 = 2"),
    ("sliding_window", lambda r: maintain.slice_window(r.withColumn("slice_id", F.expr("vec_id div 100")), 12, 5), "SELECT p_size AS list_id, p_partkey AS vec_id, p_partkey // 100 AS slice_id FROM part WHERE p_partkey // 100 BETWEEN 8 AND 12"),
    ("lookup_table", lambda r: maintain.looked_up(r.select("vec_id"), r.filter("list_id > 25"), "vec_id", "list_id"), f"SELECT vec_id, CASE WHEN list_id > 25 THEN list_id ELSE -1 END AS list_id FROM ({_UP})"),
    ("lists_by_size", maintain.lists_by_size, f"SELECT list_id, n, row_number() OVER (ORDER BY n, list_id)::INTEGER AS place FROM (SELECT list_id, count(*) AS n FROM ({_UP}) GROUP BY list_id)"),
    ("bucket_sort", lambda r: maintain.bucket_sort(r, "list_id"), f"SELECT list_id, coalesce(sum(n) OVER (ORDER BY list_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin, n FROM (SELECT list_id, count(*) AS n FROM ({_UP}) GROUP BY list_id)"),
    ("distinct_codes", lambda r: maintain.distinct_codes(r, "list_id"), f"SELECT list_id, min(vec_id) AS vec_id FROM ({_UP}) GROUP BY list_id"),
):

    def _upkeep(spark, sf, make=_make):
        return make(spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_size").alias("list_id"), F.col("p_partkey").alias("vec_id")))

    _register(_sql, _n)(_upkeep)


@_register(f"SELECT a.vec_id, a.list_id, list_transform(list_zip(a.e, c.c), lambda z: {_r(f'{_X} - {_Y}')}) AS residual FROM ({_ASSIGNED}) a JOIN ({_CENTROIDS}) c USING (list_id)")
def residuals(spark, sf):
    index = label_index(spark, sf)
    out = maintain.residuals(base(spark, sf), index.rows, index.centroid_table(spark))
    return out.select("vec_id", "list_id", F.transform("residual", topk.rounded).alias("residual"))


@_register(f"SELECT b.vec_id, list_transform(b.embedding, lambda x: x::DOUBLE) AS embedding FROM embeddings b WHERE b.vec_id % 7 = 0")
def reconstruct(spark, sf):
    ids = base(spark, sf).filter("vec_id % 7 = 0").select("vec_id")
    return label_index(spark, sf).reconstruct(ids).withColumn("embedding", F.col("embedding").cast("array<double>"))


_DUP = "SELECT p_partkey AS vec_id, [p_size / 1.0::DOUBLE, length(p_brand) / 1.0::DOUBLE] AS e FROM part"


@_register(_knn(_DUP))
def dedup_expand(spark, sf):
    """Equal vectors searched once and expanded after."""
    rows = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("vec_id"), F.array(F.col("p_size").cast("double"), F.length("p_brand").cast("double")).alias("embedding"))
    one, members = maintain.deduplicated(rows)
    found = maintain.expanded(flat.knn(asked(rows), one, K).drop("rank"), members, K)
    return topk.top_k(found, K).select("qid", "rank", "vec_id", "distance")


# --- evaluation ---------------------------------------------------------------------------

_TRUTH, _FOUND = _knn(), _top(_ivf_pairs(2), K)


def _both(spark, sf):
    rows = base(spark, sf)
    return label_index(spark, sf).search(asked(rows), K, 2), flat.knn(asked(rows), rows, K)


@_register(f"""WITH g AS ({_TRUTH}), f AS ({_FOUND}), e AS (SELECT qid, max(distance) AS edge FROM g GROUP BY qid)
SELECT {_r("sum(CASE WHEN f.distance <= edge OR abs(f.distance - edge) < 1e-4 * abs(edge) THEN 1 ELSE 0 END) / (SELECT count(*) FROM g)")} AS recall,
{_r("sum(CASE WHEN g.vec_id IS NOT NULL THEN 1 ELSE 0 END) / (SELECT count(*) FROM g)")} AS id_recall FROM f JOIN e USING (qid) LEFT JOIN g ON g.qid = f.qid AND g.vec_id = f.vec_id""")
def recall_at_k(spark, sf):
    return evaluate.recall_at_k(*_both(spark, sf), K).select(topk.rounded(F.col("recall")).alias("recall"), topk.rounded(F.col("id_recall")).alias("id_recall"))


@_register(f"SELECT {_r(f'(SELECT sum(distance) FROM ({_FOUND})) / (SELECT sum(distance) FROM ({_TRUTH})) - 1')} AS r2")
def r2_ratio(spark, sf):
    return evaluate.distance_ratio(*_both(spark, sf)).select(topk.rounded(F.col("r2")).alias("r2"))


@_register(f"WITH g AS ({_TRUTH}), f AS ({_FOUND}) SELECT {_r('avg(CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.qid = g.qid AND f.vec_id = g.vec_id AND f.rank <= 5) THEN 1.0 ELSE 0.0 END)')} AS one_recall FROM g WHERE g.rank = 1")
def one_recall_at_r(spark, sf):
    return evaluate.one_recall_at(*_both(spark, sf), 5).select(topk.rounded(F.col("one_recall")).alias("one_recall"))


@_register(f"WITH g AS ({_TRUTH}), f AS ({_FOUND}) SELECT {_r(f'(SELECT count(*) FROM f JOIN g USING (qid, vec_id)) / ((SELECT count(DISTINCT qid) FROM g) * {K})')} AS intersection")
def intersection(spark, sf):
    return evaluate.intersection(*_both(spark, sf), K).select(topk.rounded(F.col("intersection")).alias("intersection"))


_RF, _RT = f"SELECT * FROM ({_ivf_pairs(3)}) WHERE distance < 1.3", f"SELECT * FROM ({_pairs()}) WHERE distance < 1.2"


@_register(f"""WITH a AS ({_RF}), b AS ({_RT}), q AS (SELECT qid, sum(x) AS a, sum(y) AS b, sum(x * y) AS n FROM
(SELECT coalesce(a.qid, b.qid) AS qid, CASE WHEN a.qid IS NULL THEN 0 ELSE 1 END AS x, CASE WHEN b.qid IS NULL THEN 0 ELSE 1 END AS y FROM a FULL JOIN b ON a.qid = b.qid AND a.vec_id = b.vec_id) GROUP BY 1)
SELECT {_r('sum(n) / sum(a)')} AS precision, {_r('sum(n) / sum(b)')} AS recall, {_r('avg(CASE WHEN a = 0 THEN 1.0 ELSE n / a END)')} AS mean_precision, {_r('avg(CASE WHEN b = 0 THEN 1.0 ELSE n / b END)')} AS mean_recall FROM q""")
def range_precision_recall(spark, sf):
    rows = base(spark, sf)
    out = evaluate.range_precision_recall(label_index(spark, sf).range_search(asked(rows), 1.3, 3), flat.range_search(asked(rows), rows, 1.2))
    return out.select(*[topk.rounded(F.col(c)).alias(c) for c in out.columns])


@_register(f"""WITH a AS ({_RF}), b AS ({_RT}) SELECT t AS threshold, {_r('count(b.qid) / count(*)')} AS precision, {_r('count(b.qid) / (SELECT count(*) FROM b)')} AS recall
FROM (SELECT unnest([0.9, 1.0, 1.1, 1.2]::DOUBLE[]) AS t) JOIN a ON a.distance < t LEFT JOIN b ON a.qid = b.qid AND a.vec_id = b.vec_id GROUP BY t""")
def range_curve(spark, sf):
    rows = base(spark, sf)
    out = evaluate.range_curve(label_index(spark, sf).range_search(asked(rows), 1.3, 3), flat.range_search(asked(rows), rows, 1.2), [0.9, 1.0, 1.1, 1.2])
    return out.select("threshold", *[topk.rounded(F.col(c)).alias(c) for c in ("precision", "recall")])


@_register("SELECT vec_id AS qid, true AS same FROM embeddings WHERE vec_id % 20 = 0")
def compare_results(spark, sf):
    rows = base(spark, sf)
    return evaluate.agreeing_ranks(label_index(spark, sf).search(asked(rows), K, 100), flat.knn(asked(rows), rows, K))


_RUNS = "SELECT p_size AS nprobe, max(p_retailprice) AS performance, count(*)::DOUBLE AS time FROM part GROUP BY p_size"


@_register(f"SELECT nprobe, performance, time FROM (SELECT *, max(performance) OVER (ORDER BY time, performance DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM ({_RUNS})) WHERE best IS NULL OR performance > best")
def pareto(spark, sf):
    runs = spark.read.parquet(f"{sf}/part.parquet").groupBy(F.col("p_size").alias("nprobe")).agg(F.max("p_retailprice").alias("performance"), F.count("*").cast("double").alias("time"))
    return evaluate.pareto(runs)


@_register("SELECT count(*) AS nb, max(length(embedding))::INTEGER AS d FROM embeddings")
def dataset_info(spark, sf):
    return base(spark, sf).agg(F.count("*").alias("nb"), F.max(F.size("embedding")).alias("d"))


# --- transforms and codes -----------------------------------------------------------------


@_register(f"""WITH m AS (SELECT list(m ORDER BY pos) AS c FROM (SELECT pos, avg(v::DOUBLE) AS m FROM (SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY pos))
SELECT vec_id, list_transform(list_zip(embedding, c), lambda z: {_r(f'{_X} - {_Y}')}) AS embedding FROM embeddings, m""")
def center(spark, sf):
    return transform.centred(base(spark, sf).select("vec_id", "embedding")).select("vec_id", F.transform("embedding", topk.rounded).alias("embedding"))


@_register("SELECT vec_id, [embedding[64]::DOUBLE, embedding[2]::DOUBLE, 0.0, embedding[1]::DOUBLE] AS embedding FROM embeddings")
def remap_dimensions(spark, sf):
    return transform.remapped(base(spark, sf).select("vec_id", "embedding"), [63, 1, -1, 0])


_ENDS = "SELECT list(a ORDER BY pos) AS lo, list(b ORDER BY pos) AS hi FROM (SELECT pos, min(v)::DOUBLE AS a, max(v)::DOUBLE AS b FROM (SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY pos)"
_SQ8 = f"SELECT vec_id, list_transform(list_zip(embedding, lo, hi), lambda z: least(greatest(floor((z[1]::DOUBLE - z[2]) / (z[3] - z[2]) * 255 + 0.5), 0), 255)::INTEGER) AS code FROM embeddings, ({_ENDS})"


@_register(_SQ8)
def sq8_encode(spark, sf):
    q = quantize.ScalarQuantizer.train(base(spark, sf))
    low, high = (F.array(*map(F.lit, x.tolist())) for x in (q.low, q.high))
    return base(spark, sf).select("vec_id", quantize.scalar_codes(F.col("embedding"), low, high).alias("code"))


@_register(_top(f"""SELECT q.vec_id AS qid, b.vec_id, {_r(SQL_METRICS['l2']('q.embedding', 'b.e'))} AS distance FROM embeddings q,
(SELECT vec_id, list_transform(list_zip(code, lo, hi), lambda z: z[2] + z[1] / 255.0::DOUBLE * (z[3] - z[2])) AS e FROM ({_SQ8}), ({_ENDS})) b WHERE q.vec_id % 20 = 0""", K))
def sq8_knn(spark, sf):
    rows = base(spark, sf)
    q = quantize.ScalarQuantizer.train(rows)
    return q.search(asked(rows), q.encoded(rows), K)


@_register(f"""SELECT vec_id, {_r('lo')} AS low, {_r('span')} AS span, codes, list_transform(codes, lambda c: {_r('lo + c / 255.0::DOUBLE * span')}) AS decoded FROM
(SELECT vec_id, lo, span, list_transform(e, lambda x: floor((x::DOUBLE - lo) / span * 255 + 0.5)::INTEGER) AS codes FROM (SELECT vec_id, e, list_min(e)::DOUBLE AS lo, list_max(e)::DOUBLE - list_min(e)::DOUBLE AS span FROM ({B64})))""")
def rowwise_minmax(spark, sf):
    coded = base(spark, sf).select("vec_id", quantize.rowwise_codes(F.col("embedding")).alias("c"))
    return coded.select("vec_id", topk.rounded(F.col("c.low")).alias("low"), topk.rounded(F.col("c.span")).alias("span"), F.col("c.codes").alias("codes"), F.transform(quantize.rowwise_decoded(F.col("c")), topk.rounded).alias("decoded"))


@_register("SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 1 ELSE 0 END) AS bits FROM embeddings")
def lsh_bits(spark, sf):
    return binary.lsh_bits(base(spark, sf))


_HAM = "SELECT q.vec_id AS qid, b.vec_id, list_sum(list_transform(list_zip(q.embedding, b.embedding), lambda z: CASE WHEN (z[1] >= 0) <> (z[2] >= 0) THEN 1 ELSE 0 END))::BIGINT AS distance FROM embeddings q, embeddings b WHERE q.vec_id % 20 = 0"


def _bits(spark, sf):
    words = binary.from_vectors(base(spark, sf), 64)
    return words.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "qid"), words


@_register(_top(_HAM, K))
def hamming_knn(spark, sf):
    return binary.knn(*_bits(spark, sf), K)


@_register(f"SELECT * FROM ({_HAM}) WHERE distance < 22")
def hamming_range(spark, sf):
    return binary.range_search(*_bits(spark, sf), 22)


@_register(f"SELECT qid, count(*) AS n FROM ({_HAM}) WHERE distance < 26 GROUP BY qid")
def hamming_counts(spark, sf):
    return binary.match_counts(*_bits(spark, sf), 26)


_KEY = lambda t, a: "+".join(f"(CASE WHEN {a}.embedding[{8 * t + i + 1}] >= 0 THEN {1 << i} ELSE 0 END)" for i in range(8))


@_register(_top(f"SELECT q.vec_id AS qid, b.vec_id, list_sum(list_transform(list_zip(q.embedding, b.embedding), lambda z: CASE WHEN (z[1] >= 0) <> (z[2] >= 0) THEN 1 ELSE 0 END))::BIGINT AS distance FROM embeddings q, embeddings b WHERE q.vec_id % 20 = 0 AND ({' OR '.join(f'bit_count(xor(({_KEY(t, chr(113))})::INTEGER, ({_KEY(t, chr(98))})::INTEGER)) <= 1' for t in range(2))})", K))
def binary_hash(spark, sf):
    return binary.hashed_search(*_bits(spark, sf), K, bits=8, flips=1, tables=2)


@_register("SELECT a.vec_id AS i, list_sum(list_transform(list_zip(a.c, b.c), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END))::INTEGER AS differ FROM (" + _SQ8.replace("AS code", "AS c") + ") a JOIN (" + _SQ8.replace("AS code", "AS c") + ") b ON b.vec_id = a.vec_id + 1")
def generalised_hamming(spark, sf):
    codes = sq8_encode(spark, sf)
    a, b = codes.select(F.col("vec_id").alias("i"), F.col("code").alias("a")), codes.select((F.col("vec_id") - 1).alias("i"), F.col("code").alias("b"))
    return a.join(b, "i").select("i", V.generalised_hamming(F.col("a"), F.col("b")).alias("differ"))


_BITC = """SELECT label AS list_id, list(CASE WHEN 2 * ones >= n THEN 1.0 ELSE -1.0 END ORDER BY pos) AS embedding FROM (SELECT label, pos, sum(CASE WHEN v >= 0 THEN 1 ELSE 0 END) AS ones, count(*) AS n FROM
(SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos) GROUP BY label"""
_DIFFER = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: CASE WHEN (z[1] >= 0) <> (z[2] >= 0) THEN 1 ELSE 0 END))::BIGINT"


@_register(_top(f"""SELECT p.qid, a.vec_id, {_DIFFER('p.e', 'a.e')} AS distance FROM
(SELECT * FROM (SELECT q.vec_id AS qid, q.embedding AS e, c.list_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIFFER('q.embedding', 'c.embedding')}, c.list_id) AS n FROM embeddings q, ({_BITC}) c WHERE q.vec_id % 20 = 0) WHERE n <= 3) p JOIN
(SELECT * FROM (SELECT b.vec_id, b.embedding AS e, c.list_id, row_number() OVER (PARTITION BY b.vec_id ORDER BY {_DIFFER('b.embedding', 'c.embedding')}, c.list_id) AS n FROM embeddings b, ({_BITC}) c) WHERE n = 1) a USING (list_id)""", K))
def binary_ivf(spark, sf):
    bits = base(spark, sf).select("label", F.posexplode("embedding").alias("pos", "v")).groupBy("label", "pos").agg(F.avg((F.col("v") >= 0).cast("double")).alias("share"))
    rows = bits.groupBy(F.col("label").alias("list_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "share"))), lambda x: x["share"] - 0.5).alias("embedding"))
    centroids = binary.from_vectors(rows, 64, "list_id")
    q, words = _bits(spark, sf)
    return binary.ivf_knn(q, binary.assign(words, centroids), centroids, K, 3)


@_register(f"""WITH c AS ({_CENTROIDS}) SELECT qid, rank, i, j, distance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, i, j)::INTEGER AS rank FROM
(SELECT q.vec_id AS qid, a.list_id AS i, b.list_id AS j, {_r(SQL_METRICS['l2']('q.e[1:32]', 'a.c[1:32]') + ' + ' + SQL_METRICS['l2']('q.e[33:64]', 'b.c[33:64]'))} AS distance FROM ({B64}) q, c a, c b WHERE q.vec_id % 20 = 0)) WHERE rank <= {K}""")
def multi_index_probe(spark, sf):
    c = np.array([r["centroid"] for r in sorted(label_centroids(spark, sf).collect())])
    return multi.multi_probe(asked(base(spark, sf)), c[:, :32], c[:, 32:], K)


_ONE = "SELECT p_partkey AS vec_id, [p_retailprice] AS e FROM part"


@_register(_knn(_ONE))
def flat_1d(spark, sf):
    rows = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("vec_id"), F.array("p_retailprice").alias("embedding"))
    return flat.sorted_knn(asked(rows), rows, K)


@_register(f"SELECT vec_id AS qid, {K}::BIGINT AS n, true AS known FROM embeddings WHERE vec_id % 20 = 0")
def random_index(spark, sf):
    """K different ids of the base for each query."""
    rows = base(spark, sf)
    found = multi.random_results(asked(rows), rows, K).join(rows.select("vec_id", F.lit(True).alias("known")), "vec_id", "left")
    return found.groupBy("qid").agg(F.countDistinct("vec_id").alias("n"), F.min(F.coalesce("known", F.lit(False))).alias("known"))


@_register("SELECT tri_ef::INTEGER AS tri_ef, true AS most_found FROM (VALUES (0), (100)) t(tri_ef)")
def graph_knn(spark, sf):
    """Recall of the graph search is 0.95 or more, with and without the triangle test."""
    rows = base(spark, sf)
    g, truth = graph.build(rows, 16, 100), flat.knn(asked(rows), rows, K)
    plain = evaluate.recall_at_k(graph.search(g, asked(rows), K, 100), truth, K)
    both = plain.withColumn("tri_ef", F.lit(0)).union(evaluate.recall_at_k(graph.search(g, asked(rows), K, 100, 100), truth, K).withColumn("tri_ef", F.lit(100)))
    return both.select("tri_ef", (F.col("recall") >= 0.95).alias("most_found"))


_NEIGHBOURS = f"SELECT vec_id, rank, nbr_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, nbr_id)::INTEGER AS rank FROM (SELECT a.vec_id, b.vec_id AS nbr_id, {_r(SQL_METRICS['l2']('a.e', 'b.e'))} AS distance FROM ({B64}) a JOIN ({B64}) b ON a.vec_id <> b.vec_id)) WHERE rank <= {K}"


@_register(_NEIGHBOURS)
def neighbour_descent(spark, sf):
    """Up to 4096 rows, one block, descent ends where it starts: with the exact neighbours."""
    return graph.descend(base(spark, sf), K).select(F.col("vec_id"), "rank", "nbr_id", "distance")


def _codec(make, recall_of: int = 100, least: float = 0.5, most: float = 0.9):
    """Whether a search over codes has the true nearest among its first `recall_of` for a share of
    `least` of the queries, and whether decoding leaves a mean squared error below `most` (of unit
    vectors)."""

    def run(spark, sf):
        rows = base(spark, sf)
        q = make(quantize.sample(rows))
        codes = q.encoded(rows).cache()
        found, truth = q.search(asked(rows), codes, recall_of), flat.knn(asked(rows), rows, 1)
        error = rows.join(q.decoded(codes).withColumnRenamed("embedding", "back"), "vec_id").agg(F.avg(V.squared_l2(F.col("embedding"), F.col("back"))).alias("error"))
        both = evaluate.one_recall_at(found, truth, recall_of).crossJoin(error)  # one row each
        out = both.select((F.col("one_recall") >= least).alias("most_found"), (F.col("error") < most).alias("near"))
        out = spark.createDataFrame(out.collect(), out.schema)  # one row
        codes.unpersist()
        return out

    return run


for _n, _make in {
    "pq": lambda x: quantize.ProductQuantizer.train(x, 8, 6),
    "residual_quantizer": lambda x: quantize.ResidualQuantizer.train(x, 4, 5, beam=4),
    "local_search_quantizer": lambda x: quantize.LocalSearchQuantizer.train(x, 4, 5),
    "product_residual": lambda x: quantize.ProductAdditive.train(x, 2, 2, 5),
    "ivfpq": lambda x: quantize.TwoLevel.train(x, 16, 8, 6),
    "ivfpqr": lambda x: quantize.Refined.train(x, quantize.TwoLevel.train(x, 16, 8, 6), 8, 6),
    "independent_lists": lambda x: quantize.IndependentLists.train(x, np.eye(64)[:16], 16, 8, 6),
    "two_level": lambda x: quantize.TwoLevel.train(x, 8, 4, 6),
    "half_float": lambda x: quantize.HalfFloat(),
    "lattice": lambda x: quantize.Lattice.train(x, 8, 14),
    "ranked_lattice": lambda x: quantize.RankedLattice(16, 6, 64),
    "norm_coded": lambda x: quantize.NormCoded.train(x, quantize.ResidualQuantizer.train(x, 4, 5, beam=4)),
    "rowwise_half": lambda x: quantize.RowwiseMinMax(8, half=True),
    "pq_symmetric": lambda x: quantize.ProductQuantizer.train(x, 8, 6).searching("symmetric"),
    "pq_polysemous": lambda x: quantize.ProductQuantizer.train(x, 8, 6).reordered().searching("polysemous", 24),
    "ivfpq_polysemous": lambda x: quantize.TwoLevel.around(x, 8, lambda rest: quantize.ProductQuantizer.train(rest, 8, 6).reordered().searching("polysemous", 28)),
    "ivf_residual_quantizer": lambda x: quantize.TwoLevel.around(x, 8, lambda rest: quantize.ResidualQuantizer.train(rest, 4, 5)),
    "ivf_sq4": lambda x: quantize.TwoLevel.around(x, 8, lambda rest: quantize.ScalarQuantizer(rest.min(axis=0), rest.max(axis=0), 4)),
    "ivf_spectral_hash": lambda x: quantize.TwoLevel.around(x, 4, lambda rest: quantize.SpectralHash.train(rest, 32, 0.5)),
}.items():
    # points and hashes keep directions, not lengths
    _loose = {"most": 20.0} if _n in ("ranked_lattice",) else {"most": 1e9, "least": 0.3} if _n == "ivf_spectral_hash" else {}
    _register("SELECT true AS most_found, true AS near", f"codec_{_n}")(_codec(_make, **_loose))


@_register("SELECT true AS keeps_most, true AS undone")
def pca(spark, sf):
    """16 components of 64 keep more than an even share of the variance, and a rotation is undone."""
    rows = base(spark, sf).select("vec_id", "embedding")
    _, _, cov = transform.moments(rows)
    p = transform.pca(rows, 16)
    turn = transform.rotation(64)
    back = turn.reverse(turn.apply(rows)).withColumnRenamed("embedding", "back")
    kept = p.apply(rows).agg(F.avg(V.squared_norm(F.col("embedding"))).alias("kept"))
    error = rows.join(back, "vec_id").agg(F.max(V.squared_l2(F.col("embedding"), F.col("back"))).alias("error"))
    return kept.crossJoin(error).select((F.col("kept") / F.lit(float(np.trace(cov))) > 0.25).alias("keeps_most"), (F.col("error") < 1e-9).alias("undone"))  # one row each


# --- more searches and measures -----------------------------------------------------------


@_register(_top(_ivf_pairs(3), K))
def big_batch_knn(spark, sf):
    """Queries dealt to lists, lists met piece by piece, slices written one by one."""
    path = f"{shared_folder(spark)}/batch-{uuid.uuid4().hex}"
    return batch.big_batch(label_index(spark, sf), asked(base(spark, sf)), K, 3, path, slices=2, rows=64, most=16)


@_register(_knn())
def running_knn(spark, sf):
    """The k best so far over four blocks of the base."""
    return batch.running_knn(asked(base(spark, sf)), base(spark, sf), K, f"{shared_folder(spark)}/running-{uuid.uuid4().hex}", blocks=4)


@_register(_top(f"""WITH s AS (SELECT list_id, count(*) AS n FROM ({_ASSIGNED}) GROUP BY list_id), p AS (SELECT qid, e, list_id, coalesce(sum(coalesce(n, 0)) OVER (PARTITION BY qid ORDER BY probe_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({_PROBES}) LEFT JOIN s USING (list_id))
SELECT p.qid, a.vec_id, {_r(SQL_METRICS['l2']('p.e', 'a.e'))} AS distance FROM p JOIN ({_ASSIGNED}) a USING (list_id) WHERE p.before < 150""", K))
def ivf_knn_max_codes(spark, sf):
    return label_index(spark, sf).search(asked(base(spark, sf)), K, 100, max_codes=150)


@_register(_knn(PART))
def ivf_axes(spark, sf):
    """Vectors ruled out by their angle to the axes, as seen from the centroid."""
    rows = parts(spark, sf)
    return trained_index(rows, TRI).search(asked(rows), K, 16, axes=2)


@_register(_knn(PART))
def ivf_random_neighbours(spark, sf):
    """The neighbour rules over random members of a list."""
    rows = parts(spark, sf)
    plain = trained_index(rows, 0)
    return IvfIndex(plain.centroids, plain.rows, opt=7).with_random_neighbours().search(asked(rows), K, 16)


@_register(_knn(where="b.vec_id % 7 <> 0"))
def knn_not_deleted(spark, sf):
    """Vectors with a deletion mark are no results."""
    rows = base(spark, sf)
    marks = rows.filter("vec_id % 7 = 0").select("vec_id")
    return flat.knn(asked(rows), select.in_table(rows, marks, keep=False), K)


@_register("SELECT vec_id AS qid, true AS fits FROM embeddings WHERE vec_id % 20 = 0")
def graph_knn_filtered(spark, sf):
    """A graph search under a selector returns selected vectors only, K a query."""
    rows = base(spark, sf)
    found = graph.search(graph.build(rows, 16, 100), asked(rows), K, 200, allowed=select.Predicate(lambda c: c % 3 == 1))
    return found.groupBy("qid").agg((F.min((F.col("vec_id") % 3 == 1).cast("int")) * (F.count("*") == K).cast("int") == 1).alias("fits"))


@_register(f"SELECT q.vec_id AS qid, list({_r(SQL_METRICS['l2']('q.e', 'c.c'))} ORDER BY c.list_id) AS distances FROM ({B64}) q, ({_CENTROIDS}) c WHERE q.vec_id % 20 = 0 GROUP BY q.vec_id")
def pairwise_l2(spark, sf):
    """The matrix of queries by centroids."""
    c = label_centroids(spark, sf).select(F.col("list_id").cast("long").alias("vec_id"), F.col("centroid").alias("embedding"))
    return flat.pairwise(asked(base(spark, sf)), c)


@_register(f"SELECT vec_id, (list_position(m, list_min(m)) - 1)::INTEGER AS at, {_r('list_min(m)')} AS least FROM (SELECT vec_id, list_transform(list_zip(e, list_reverse(e)), lambda z: {_X} + 2 * {_Y}) AS m FROM ({B64}))")
def multiply_add_argmin(spark, sf):
    found = base(spark, sf).select("vec_id", V.multiply_add_argmin(F.col("embedding"), 2.0, F.reverse("embedding")).alias("f"))
    return found.select("vec_id", F.col("f.at").alias("at"), topk.rounded(F.col("f.least")).alias("least"))


_SPARSE = "SELECT vec_id, pos, v FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings) WHERE abs(v) > 0.15"


@_register(f"""WITH x AS ({_SPARSE}), c AS (SELECT list_id, unnest(c) AS c, generate_subscripts(c, 1) - 1 AS pos FROM ({_CENTROIDS})), cc AS (SELECT list_id, sum(c * c) AS cc FROM c GROUP BY list_id), xx AS (SELECT vec_id, sum(v * v) AS xx FROM x GROUP BY vec_id),
d AS (SELECT x.vec_id, c.list_id, sum(x.v * c.c) AS xc FROM x JOIN c USING (pos) GROUP BY ALL) SELECT vec_id, list_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, list_id) AS n FROM
(SELECT xx.vec_id, cc.list_id, {_r('xx + cc - 2 * coalesce(xc, 0)')} AS distance FROM xx CROSS JOIN cc LEFT JOIN d ON d.vec_id = xx.vec_id AND d.list_id = cc.list_id)) WHERE n = 1""")
def sparse_assign(spark, sf):
    """Sparse vectors (entries above 0.15) to their nearest centroid, by products of entries."""
    x = base(spark, sf).select("vec_id", F.posexplode("embedding").alias("pos", "v")).withColumn("value", F.col("v").cast("double")).filter("abs(value) > 0.15")
    return kmeans.sparse_assign(x.select("vec_id", "pos", "value"), label_centroids(spark, sf))


@_register(f"SELECT (pos - 1)::INTEGER AS pos, byte, count(*) AS n FROM (SELECT generate_subscripts(code, 1) AS pos, unnest(code) AS byte FROM ({_SQ8})) GROUP BY ALL")
def byte_histogram(spark, sf):
    return maintain.byte_histogram(sq8_encode(spark, sf))


@_register(f"WITH p AS ({_pairs()}), e AS (SELECT qid, max(distance) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, vec_id) AS n FROM p) WHERE n <= 25 GROUP BY qid) SELECT qid, threshold, count(*) AS n FROM p JOIN e USING (qid) WHERE distance <= threshold GROUP BY ALL")
def partition_threshold(spark, sf):
    """The distance that splits each query's 25 nearest from the rest."""
    rows = base(spark, sf)
    return topk.partition(flat.range_search(asked(rows), rows, 100.0), 25)


@_register(f"""WITH g AS ({_TRUTH}), f AS ({_FOUND}), e AS (SELECT qid, max(distance) AS edge FROM g GROUP BY qid)
SELECT {_r('avg(share)')} AS similarity FROM (SELECT f.qid, avg(CASE WHEN g.vec_id IS NOT NULL OR f.distance <= edge + 1e-6 THEN 1.0 ELSE 0.0 END) AS share FROM f JOIN e USING (qid) LEFT JOIN g ON g.qid = f.qid AND g.vec_id = f.vec_id GROUP BY f.qid)""")
def similarity(spark, sf):
    return evaluate.similarity(*_both(spark, sf)).select(topk.rounded(F.col("similarity")).alias("similarity"))


@_register(f"""WITH a AS ({_RF}), b AS ({_RT}) SELECT coalesce(a.qid, b.qid) AS qid, count(*) FILTER (b.qid IS NULL) AS only_a, count(*) FILTER (a.qid IS NULL) AS only_b, count(*) FILTER (a.distance <> b.distance) AS moved
FROM a FULL JOIN b ON a.qid = b.qid AND a.vec_id = b.vec_id GROUP BY 1""")
def compare_ranges(spark, sf):
    rows = base(spark, sf)
    return evaluate.compare_ranges(label_index(spark, sf).range_search(asked(rows), 1.3, 3), flat.range_search(asked(rows), rows, 1.2))


@_register(f"""WITH a AS ({_RF}), b AS (SELECT *, CASE WHEN distance < 0.8 THEN 4.0 WHEN distance < 1.1 THEN 1.0 ELSE 0.0 END AS w FROM ({_RT}))
SELECT {_r('sum(CASE WHEN a.qid IS NOT NULL THEN w ELSE 0 END) / sum(w)')} AS weighted_recall FROM b LEFT JOIN a ON a.qid = b.qid AND a.vec_id = b.vec_id""")
def weighted_range_recall(spark, sf):
    rows = base(spark, sf)
    out = evaluate.weighted_range_recall(label_index(spark, sf).range_search(asked(rows), 1.3, 3), flat.range_search(asked(rows), rows, 1.2), [(0.8, 4.0), (1.1, 1.0)])
    return out.select(topk.rounded(F.col("weighted_recall")).alias("weighted_recall"))


@_register("SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 127 + 128)::INTEGER) AS code FROM embeddings")
def sq8_direct(spark, sf):
    """Whole numbers from 0 to 255 are their own codes."""
    return quantize.Direct8().encoded(whole(spark, sf))
