import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from workload.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    yield session
    session.stop()


@pytest.fixture
def ws(spark, tmp_path):
    from marginspark.workspace import Workspace

    return Workspace(spark, str(tmp_path))


def blobs(rows=200, gap=1.5, seed=0):
    """Two blobs in the plane with a bias feature."""
    rng = np.random.default_rng(seed)
    y = np.where(np.arange(rows) % 2 == 0, 1, -1)
    X = rng.normal(size=(rows, 2)) + gap * 0.5 * y[:, None]
    return np.c_[X, np.ones(rows)], y


def frame(spark, X, y):
    rows = [(i, [float(v) for v in x], int(t)) for i, (x, t) in enumerate(zip(X, y))]
    return spark.createDataFrame(rows, "id bigint, x array<double>, y int")


@pytest.fixture(scope="session")
def blob_points(spark):
    X, y = blobs()
    points = frame(spark, X, y).repartition(5).cache()
    points.count()
    return points
