"""A table function for SQL: SELECT * FROM knn(qid, embedding) against a base of a checked size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from tessera.functions.kernels import KERNELS, Best
from tessera.functions.vectors import METRICS
from tessera.operators.flat import centroid_block


def register_knn(spark: SparkSession, base: DataFrame, k: int, metric: str = "l2", name: str = "knn") -> None:
    """Registers name(qid, embedding), which gives (rank, vec_id, distance) rows; call it laterally:

        SELECT q.qid, n.* FROM queries q, LATERAL knn(q.qid, q.embedding) n

    base: (vec_id, embedding) of at most flat.BLOCK_BYTES, which travels with the function; larger
    ones are searched by flat.knn.
    """
    ids, x = centroid_block(base.selectExpr("vec_id AS list_id", "embedding AS centroid"))
    greater = METRICS[metric][1]

    class Nearest:
        def eval(self, qid: int, embedding: list):
            if embedding is None:
                return
            best = Best(1, k, greater)
            best.scan(np.array([embedding], dtype=float), x, ids, KERNELS[metric])
            for rank, (i, d) in enumerate(zip(*best.rows()[1:], strict=True), 1):
                yield rank, int(i), float(d)

    spark.udtf.register(name, udtf(Nearest, returnType="rank int, vec_id long, distance double"))
