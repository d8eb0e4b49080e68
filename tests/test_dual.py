import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginspark.operators import dual, placement, primal
from marginspark.params import MarginParams
from tests import brute
from tests.conftest import blobs, frame

P = MarginParams()


def sorted_state(df):
    pdf = df.select("id", "zeta", "beta", "slot", "part").toPandas().sort_values("id")
    return pdf.reset_index(drop=True)


@settings(max_examples=25, deadline=None)
@given(
    rows=st.integers(1, 150),
    scale=st.floats(0.1, 5.0),
    m=st.floats(1.0, 2000.0),
    sweeps=st.integers(0, 8),
    seed=st.integers(0, 10_000),
)
def test_descent_visits_rows_one_by_one(rows, scale, m, sweeps, seed):
    rng = np.random.default_rng(seed)
    X = np.c_[rng.normal(size=(rows, 3)) * scale, np.ones(rows)]
    y = np.where(rng.random(rows) < 0.5, 1.0, -1.0)
    start = np.maximum(rng.normal(size=2 * rows), 0.0) * 0.1
    got = dual.descend(X, y, start[:rows], start[rows:], P, m, sweeps)
    want = brute.dense_descent(X, y, P, m, sweeps, start)
    for a, b in zip(got, want):
        np.testing.assert_allclose(a, b, atol=1e-9)
        assert (a >= 0).all()


def test_dual_value_never_rises():
    X, y = blobs()
    values = []
    brute.dense_descent(X, y, P, 200, 30, values=values)
    H = brute.hessian(X, y, P, 200)
    ours = [
        brute.dual_value(
            np.r_[dual.descend(X, y.astype(float), np.zeros(200), np.zeros(200), P, 200, t)],
            H, P,
        )
        for t in range(6)
    ]
    assert (np.diff(ours) <= 1e-12).all()
    np.testing.assert_allclose(ours, values[:6], atol=1e-10)


@pytest.mark.parametrize("split", [False, True])
def test_single_part_dual_equals_primal_optimum(spark, ws, blob_points, split):
    X, y = blobs()
    solved = dual.solve_parts(
        dual.zero_duals(blob_points), MarginParams(tol=1e-12), 200, None if split else 5000, 1, ws,
        max_part_rows=0 if split else 1000,
    ).cache()
    w = primal.to_vector(primal.recover_weights(solved, 3), 3)
    best = brute.primal_optimum(X, y, P, 200)
    np.testing.assert_allclose(w, best, atol=1e-8)
    value = dual.dual_objective(solved, P, 200, 3)
    assert abs(value + brute.objective(best, X, y, P, 200)) < 1e-8
    assert sorted_state(solved)["slot"].tolist() == list(range(200))


def test_large_and_small_parts_side_by_side(spark, ws):
    """One part holds most rows and is solved over many tasks, the others fit."""
    X, y = blobs(600)
    points = frame(spark, X, y).withColumn(
        "part", F.when(F.col("id") % 3 < 2, 0).otherwise((1 + F.col("id") % 2).cast("int"))
    )
    sharp = MarginParams(tol=1e-13)
    state = dual.zero_duals(points)
    sizes = dual.part_sizes(state, 200)
    assert (sizes.n_parts, sizes.n_rows, sizes.n_split_parts) == (3, 600, 1)
    mixed = dual.solve_parts(state, sharp, 6000, None, 3, ws, max_part_rows=200)
    whole = dual.solve_parts(state, sharp, 6000, 4000, 3, ws, max_part_rows=10_000)
    a, b = sorted_state(mixed), sorted_state(whole)
    assert len(a) == 600
    np.testing.assert_allclose(a["zeta"], b["zeta"], atol=1e-9)
    np.testing.assert_allclose(a["beta"], b["beta"], atol=1e-9)
    assert (a["slot"] == b["slot"]).all() and (a["part"] == b["part"]).all()


@pytest.mark.parametrize("scale", ["global", "local"])
@pytest.mark.parametrize("sweeps", [0, 1, 5, None])
def test_the_limit_does_not_change_the_answer(spark, ws, sweeps, scale):
    X, y = blobs(260)
    points = frame(spark, X, y).withColumn("part", F.when(F.col("id") < 160, 0).otherwise(1))
    state = dual.zero_duals(points).withColumn("zeta", F.lit(0.01))
    runs = [
        sorted_state(dual.solve_parts(state, P, 260, sweeps, 2, ws, scale, max_part_rows=limit))
        for limit in (70, 120, 1000)
    ]
    for got in runs[:2]:
        np.testing.assert_allclose(got["zeta"], runs[2]["zeta"], atol=1e-6 if sweeps is None else 1e-11)
        np.testing.assert_allclose(got["beta"], runs[2]["beta"], atol=1e-6 if sweeps is None else 1e-11)
        assert (got["slot"] == runs[2]["slot"]).all()


def test_warm_start_and_local_scale_over_many_tasks(spark, ws):
    X, y = blobs(120)
    points = frame(spark, X, y).withColumn("part", (F.col("id") % 2).cast("int"))
    state = dual.zero_duals(points).withColumns(
        {"zeta": F.lit(0.3), "beta": F.lit(0.1)}
    )
    sharp = MarginParams(tol=1e-13)
    got = sorted_state(
        dual.solve_parts(state, sharp, 120, None, 2, ws, scale="local", max_part_rows=0)
    )
    for part in (0, 1):
        at = np.arange(120) % 2 == part
        margin = y[at] * (X[at] @ brute.primal_optimum(X[at], y[at], P, 60))
        z = np.maximum(P.low - margin, 0) / P.ridge(60)
        b = np.maximum(margin - P.high, 0) * P.mu / P.ridge(60)
        np.testing.assert_allclose(got["zeta"][at], z, atol=1e-8)
        np.testing.assert_allclose(got["beta"][at], b, atol=1e-8)


def test_in_task_solution_is_the_dense_one_per_part(spark, ws, blob_points):
    X, y = blobs()
    points = placement.random_split(blob_points, 4, 1)
    part = points.select("id", "part").toPandas().set_index("id").sort_index()["part"]
    got = sorted_state(dual.solve_parts(dual.zero_duals(points), P, 200, 3, 4, ws))
    for k in range(4):
        at = (part == k).to_numpy()
        z, b = brute.dense_descent(X[at], y[at], P, 200, 3)
        np.testing.assert_allclose(got["zeta"][at], z, atol=1e-10)
        np.testing.assert_allclose(got["beta"][at], b, atol=1e-10)
        assert got["slot"][at].tolist() == list(range(at.sum()))


def test_placement_moves_each_part_in_one_exchange(spark, blob_points):
    points = placement.random_split(blob_points, 4, 1)
    solved = dual._solve_in_tasks(dual.zero_duals(points), 4, P, 200, 3, "global")
    plan = solved._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("InMemoryRelation")[0]
    assert plan.lower().count("exchange shufflepartitionidpassthrough") == 1
    assert plan.count("Exchange") == 1


@pytest.mark.parametrize("limit", [512, 0])
@pytest.mark.parametrize("split", [False, True])
def test_optimum_with_and_without_second_derivatives(
    spark, ws, blob_points, monkeypatch, limit, split
):
    """``sweeps=None``, in one task or many, for short and for wide vectors."""
    from marginspark.operators import damped

    monkeypatch.setattr(damped, "HESSIAN_LIMIT", limit)
    X, y = blobs()
    solved = dual.solve_parts(
        dual.zero_duals(blob_points), P, 200, None, 1, ws,
        max_part_rows=0 if split else 1000,
    )
    got = sorted_state(solved)
    s = y * (X @ brute.primal_optimum(X, y, P, 200))
    c = P.ridge(200)
    np.testing.assert_allclose(got["zeta"], np.maximum(P.low - s, 0) / c, atol=1e-6)
    np.testing.assert_allclose(
        got["beta"], np.maximum(s - P.high, 0) * P.mu / c, atol=1e-6
    )


@pytest.mark.parametrize("split,sweeps", [(False, None), (False, 3), (True, None)])
def test_nan_is_reported(spark, ws, split, sweeps):
    points = frame(spark, [[1.0, 1.0], [float("nan"), 1.0]], [1, -1])
    with pytest.raises(Exception, match="not finite"):
        dual.solve_parts(
            dual.zero_duals(points), P, 2, sweeps, 1, ws,
            max_part_rows=0 if split else 9,
        ).collect()


@pytest.mark.parametrize("kept", [0, 2])
def test_matrices_that_are_not_kept_give_the_same_moves(monkeypatch, kept):
    X, y = blobs(400)
    want = brute.dense_descent(X, y, P, 400, 6)
    monkeypatch.setattr(dual, "KEPT_CELLS", kept * 3 * dual._CHUNK**2)
    got = dual.descend(X, y.astype(float), np.zeros(400), np.zeros(400), P, 400, 6)
    for a, b in zip(got, want):
        np.testing.assert_allclose(a, b, atol=1e-10)


def test_a_part_that_fits_a_task_is_stored_by_no_sweep(spark, ws):
    """120,000 rows of one part: one exchange for all sweeps, no table."""
    rows = 120_000
    x = F.array((F.col("id") % 7 - 3) / 3.0, (F.col("id") % 11 - 5) / 5.0, F.lit(1.0))
    points = spark.range(rows).select("id", x.alias("x"), F.when(F.col("id") % 7 > 3, 1).otherwise(-1).alias("y"))
    solved = dual.solve_parts(dual.zero_duals(points), P, rows, 1, 1, ws)
    assert not ws._paths
    plan = solved._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    got = sorted_state(solved)
    assert (got["slot"] == np.arange(rows)).all()
    pdf = points.toPandas().sort_values("id")
    want = dual.descend(
        np.array(pdf["x"].tolist()), pdf["y"].to_numpy(float), np.zeros(rows), np.zeros(rows), P, rows, 1
    )
    np.testing.assert_allclose(got["zeta"], want[0], atol=1e-12)
    np.testing.assert_allclose(got["beta"], want[1], atol=1e-12)
