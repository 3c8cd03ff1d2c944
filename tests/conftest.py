import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    return SMALL


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return connection


def canonical(frame) -> list[tuple]:
    """Rows of a pandas frame in a form that compares across engines."""
    import numpy as np
    import pandas

    def one(v):
        if v is None or v is pandas.NA or isinstance(v, float) and v != v:
            return "null"
        if isinstance(v, bool | np.bool_):
            return str(bool(v))
        if isinstance(v, float | np.floating):
            return repr(round(float(v), 6) + 0.0)
        if isinstance(v, list | tuple | np.ndarray):
            return "[" + ",".join(map(one, v)) + "]"
        return str(int(v)) if isinstance(v, int | np.integer) else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(one, r)) for r in frame.itertuples(index=False))
