"""Training with a Gaussian kernel by its feature map, against dense forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginspark.operators import clustering as C
from marginspark.operators import dual
from marginspark.params import MarginParams
from marginspark.plans.hierarchy import FeatureMap, Policy, fit_hierarchy, rbf_features
from marginspark.workspace import Workspace
from tests import brute
from tests.conftest import blobs, frame

P = MarginParams()
SIGMA = 0.3


def gram(X, Z, sigma=SIGMA):
    return np.exp(-((X[:, None] - Z[None]) ** 2).sum(axis=2) / (2 * sigma**2))


@pytest.fixture(scope="module")
def cloud(spark):
    X, y = blobs(90, gap=0.8, seed=5)
    return X, y, frame(spark, X, y).repartition(4).cache()


def test_features_give_the_kernel_back(spark, cloud):
    X, _, points = cloud
    chosen = [x for _, x in C.landmarks(points, 90, sigma=SIGMA)]
    assert len(chosen) > 60
    rows = C.feature_map(points, chosen, "rbf", SIGMA).orderBy("id").collect()
    Z = np.array([r["x"] for r in rows])
    np.testing.assert_allclose(Z @ Z.T, gram(X, X), atol=1e-8)
    assert [r["y"] for r in rows] == [r["y"] for r in points.orderBy("id").collect()]


def test_few_landmarks_give_the_projection(spark, cloud):
    X, _, points = cloud
    chosen = np.array([x for _, x in C.landmarks(points, 12, sigma=SIGMA)])
    Z = np.array([r["x"] for r in C.feature_map(points, chosen, "rbf", SIGMA).orderBy("id").collect()])
    K = gram(X, chosen)
    np.testing.assert_allclose(Z @ Z.T, K @ np.linalg.solve(gram(chosen, chosen), K.T), atol=1e-8)
    residual = 1 - (Z**2).sum(axis=1)
    assert (residual > -1e-9).all() and residual.max() < 1


@pytest.mark.parametrize("split", [False, True])
def test_all_rows_as_landmarks_give_the_dense_dual(spark, cloud, split):
    X, y, points = cloud
    policy = Policy(2, "random", 0)
    fit = fit_hierarchy(
        points, policy, P, levels=0, fraction=1.0, kernel="rbf", sigma=SIGMA, rank=90,
        max_part_rows=0 if split else 1000,
    )
    # Any square root of the dense Gram (with its bias) is a linear problem of
    # the same dual.
    dense = gram(X, X) + 1.0
    root = np.linalg.cholesky(dense + 1e-13 * np.eye(90))
    w = brute.primal_optimum(root, y, P, 90)
    want = root @ w
    got = [r["score"] for r in fit.scores(points).orderBy("id").collect()]
    np.testing.assert_allclose(got, want, atol=1e-5)
    coef = np.zeros(90)
    for r in fit.last_coef.collect():
        coef[r["id"]] = r["coef"]
    np.testing.assert_allclose(dense @ coef, want, atol=1e-5)


@pytest.mark.parametrize("policy", ["distribution_aware", "cascade", "divide_conquer"])
def test_policies_reach_the_optimum_of_the_map(spark, policy):
    rng = np.random.default_rng(3)
    X = rng.uniform(-1, 1, (400, 2))
    y = np.where((X**2).sum(axis=1) < 0.5, 1, -1)  # no line parts a disc
    points = frame(spark, np.c_[X, np.ones(400)], y).repartition(3)
    kw = {"levels": 2, "fraction": 1.0, "seed": 2, "n_clusters": 8}
    curved = fit_hierarchy(points, policy, P, kernel="rbf", sigma=0.5, rank=25, **kw)
    flat = fit_hierarchy(points, policy, P, **kw)

    def right(fit):
        return np.mean([(r["score"] > 0) == (y[r["id"]] > 0) for r in fit.scores(points).collect()])

    assert right(curved) > 0.95 and right(flat) < 0.8
    assert curved.n == len(curved.features.landmarks) + 1 and flat.features is None


def test_nearest_image_is_the_nearest_by_the_kernel(spark, cloud):
    X, _, points = cloud
    features = rbf_features(points, 7, SIGMA, 1.0)
    near = C.assign(features(points), features.images(), "euclid").orderBy("id").collect()
    want = gram(X, np.array(features.landmarks)).argmax(axis=1)
    assert [r["cid"] for r in near] == want.tolist()
    assert FeatureMap(features.landmarks, SIGMA) == features


def test_sigma_in_assignment_and_kernel_vectors(spark, cloud):
    X, _, points = cloud
    Z = X[:3]
    rows = C.assign(points, Z, "rbf", distance="d", sigma=0.7).orderBy("id").collect()
    best = gram(X, Z, 0.7).max(axis=1)
    np.testing.assert_allclose([r["d"] for r in rows], np.sqrt(2 - 2 * best), atol=1e-7)
    kq = C.kernel_vectors(points, Z, sigma=0.7).orderBy("id").collect()
    np.testing.assert_allclose([r["kq"] for r in kq], gram(X, Z, 0.7), atol=1e-12)


def test_unknown_kernel_is_refused(spark, cloud):
    with pytest.raises(ValueError, match="kernel"):
        fit_hierarchy(cloud[2], "cascade", P, kernel="cubic")


def test_factor_counts_ties_at_the_lowest_score(spark, monkeypatch):
    # More equal rows than candidates: the least id is still the pick.
    X = np.r_[np.tile([0.0, 0.0, 1.0], (40, 1)), np.tile([3.0, 0.0, 1.0], (40, 1)), [[0.0, 4.0, 1.0]]]
    points = frame(spark, X, np.ones(81))
    monkeypatch.setattr(C, "CANDIDATES_PER_PASS", 5)
    picked = [i for i, _ in C.landmarks(points, 5, sigma=1.0)]
    assert picked == [0, 80, 40]


def widths(monkeypatch):
    """The longest vectors of the tables that a workspace stores, by name."""
    found, plain = [], Workspace.save

    def save(self, df, name):
        table = plain(self, df, name)
        if "x" in table.columns:
            found.append((name, table.agg(F.max(F.size("x"))).first()[0]))
        return table

    monkeypatch.setattr(Workspace, "save", save)
    return found


@pytest.mark.parametrize(
    "policy,levels,rows",
    [
        ("distribution_aware", 2, 1000), ("distribution_aware", 2, 0),
        (Policy(2, "kmeans", 0, support_only=True, kmeans_iterations=2), 1, 1000),
        (Policy(3, "cluster", 1, final_gather=True, kmeans_iterations=2), 1, 1000),
    ],
)
def test_rows_are_stored_with_the_vectors_that_were_given(
    spark, cloud, ws, monkeypatch, policy, levels, rows
):
    """Coordinates in the span of the landmarks, ten times as many numbers, are
    neither stored nor moved."""
    stored = widths(monkeypatch)
    kw = {"levels": levels, "fraction": 1.0, "n_clusters": 8, "kernel": "rbf", "sigma": SIGMA, "rank": 30}
    fit = fit_hierarchy(cloud[2], policy, P, workspace=ws, max_part_rows=rows, **kw)
    assert stored and {n for _, n in stored} <= {None, 3}
    assert fit.n == 31
    # what the fit says of its last level is said of the mapped rows, as before
    mapped = {r["id"]: r["x"] for r in fit.features(cloud[2]).collect()}
    for r in fit.duals.collect():
        np.testing.assert_allclose(r["x"], mapped[r["id"]], atol=1e-9)


@pytest.mark.parametrize("sweeps,rows,levels", [(None, 0, 0), (None, 45, 1), (1, 50, 0), (1, 1000, 1)])
def test_images_made_in_tasks_give_the_problem_of_the_mapped_rows(spark, cloud, ws, sweeps, rows, levels):
    _, _, points = cloud
    features = rbf_features(points, 40, SIGMA, 1.0)
    policy = Policy(2, "random", 0)
    kw = {"levels": levels, "sweeps": sweeps, "max_part_rows": rows, "seed": 1, "fraction": 1.0}
    want = fit_hierarchy(features(points).cache(), policy, P, workspace=ws, **kw)
    got = fit_hierarchy(points, policy, P, workspace=ws, kernel="rbf", sigma=SIGMA, rank=40, **kw)
    a, b = (f.coef.toPandas().sort_values(["level", "id"]) for f in (got, want))
    assert (a[["level", "id"]].to_numpy() == b[["level", "id"]].to_numpy()).all()
    np.testing.assert_allclose(a["coef"], b["coef"], atol=1e-7)


def test_a_part_in_a_task_need_not_hold_its_images():
    X, y = blobs(700, gap=0.8, seed=2)
    image = C.Image(X[:20], "rbf", 0.5, bias=True)
    state = np.linspace(0, 0.1, 700), np.linspace(0.1, 0, 700)
    want = dual.settle(image(X), y, *state, P, 700)
    for cells in (0, 10**6):
        got = dual.settle(X, y, *state, P, 700, image, cells)
        np.testing.assert_allclose(got, want, atol=1e-9)
    with pytest.raises(ValueError, match="landmarks of 3"):
        image(np.ones((4, 21)))


@pytest.mark.parametrize("n", [1, 2, 4, 7, 8, 9, 20])
def test_kernel_values_of_short_and_long_vectors(n):
    rng = np.random.default_rng(n)
    A, L = rng.normal(size=(2500, n)), rng.normal(size=(6, n))
    plain = np.exp(-((A[:, None] - L[None]) ** 2).sum(axis=2) / (2 * 0.7**2))
    np.testing.assert_allclose(C._kernel(A, L, "rbf", 0.7), plain, rtol=1e-12)


def test_a_stopped_kernel_run_goes_on(spark, cloud, ws, tmp_path, monkeypatch):
    kw = {"levels": 3, "fraction": 1.0, "n_clusters": 8, "kernel": "rbf", "sigma": SIGMA, "rank": 20}
    whole = fit_hierarchy(cloud[2], "distribution_aware", P, workspace=ws, **kw)
    folder, solve, done = str(tmp_path / "out"), dual.solve_parts, []

    def stops(*args, **kw):
        done.append(1)
        if len(done) == 2:
            raise InterruptedError
        return solve(*args, **kw)

    monkeypatch.setattr(dual, "solve_parts", stops)
    with pytest.raises(InterruptedError):
        fit_hierarchy(cloud[2], "distribution_aware", P, workspace=ws, sink_dir=folder, **kw)
    monkeypatch.setattr(dual, "solve_parts", solve)
    fit = fit_hierarchy(cloud[2], "distribution_aware", P, workspace=ws, sink_dir=folder, resume=True, **kw)
    a, b = (f.coef.toPandas().sort_values(["level", "id"]) for f in (fit, whole))
    assert (a[["level", "id"]].to_numpy() == b[["level", "id"]].to_numpy()).all()
    np.testing.assert_allclose(a["coef"], b["coef"], atol=1e-9)
