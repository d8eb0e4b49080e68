import numpy as np
import pytest

from marginspark.operators import primal
from marginspark.params import MarginParams
from tests import brute
from tests.conftest import blobs, frame

P = MarginParams()
X, Y = blobs()


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_gradient_is_the_slope_of_the_objective(spark, blob_points, seed):
    w = np.random.default_rng(seed).normal(size=3)
    g = primal.gradient_vector(blob_points, w, P, len(Y))
    np.testing.assert_allclose(g, brute.gradient(w, X, Y, P, len(Y)), atol=1e-10)
    for j in range(3):
        h = np.eye(3)[j] * 1e-6
        up, down = (
            primal.objective(blob_points, w + d, P, len(Y)).first()[0] for d in (h, -h)
        )
        assert abs((up - down) / 2e-6 - g[j]) < 1e-4


def test_wide_and_short_paths_agree(spark, blob_points, monkeypatch):
    w = np.array([0.7, -1.2, 0.4])
    short = primal.gradient_vector(blob_points, w, P, 200)
    monkeypatch.setattr(primal, "UNROLL_LIMIT", 0)
    wide = primal.gradient_vector(blob_points, w, P, 200)
    np.testing.assert_allclose(short, wide, atol=1e-12)


def test_ragged_vectors_are_reported(spark, monkeypatch):
    monkeypatch.setattr(primal, "UNROLL_LIMIT", 0)
    points = spark.createDataFrame(
        [(0, [1.0, 1.0], 1), (1, [1.0], -1)], "id bigint, x array<double>, y int"
    ).coalesce(1)
    with pytest.raises(Exception, match="equal length"):
        primal.gradient_vector(points, [0.0, 0.0], P, 2)


def test_empty_points_give_the_norm_term(spark):
    empty = frame(spark, np.ones((1, 2)), [1]).where("id < 0")
    assert primal.gradient_vector(empty, [1.0, 2.0], P, 1).tolist() == [1.0, 2.0]
    assert primal.batch_loss(empty, [1.0, 2.0], P, 1).first()[0] == 0.0


def test_band_bounds_are_strict(spark):
    # margins exactly 1 - theta and 1 + theta cost nothing
    points = frame(spark, [[0.5], [1.5], [0.25], [2.0]], [1, 1, 1, 1])
    rows = {r["band"]: r["n"] for r in primal.band_summary(points, [1.0], P, 4).collect()}
    assert rows == {"mid": 2, "low": 1, "high": 1}
