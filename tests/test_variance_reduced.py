import numpy as np
import pytest
from pyspark.sql import functions as F

from marginspark import MarginParams, fit_block_svrg, fit_stratified_svrg, fit_svrg
from marginspark.operators import sampling
from marginspark.plans import variance_reduced as vr
from tests import brute
from tests.conftest import blobs

P = MarginParams(eta=1e-3)
X, Y = blobs()
M = len(Y)


def naive_mean(Xb, yb, start, anchor, full, p, pull):
    """The step written with sample gradients as they are defined."""

    def sample_gradient(w, x, t):
        return brute.gradient(w, x[None], np.array([t]), p, 1)

    x, total = start.copy(), np.zeros_like(start)
    for row, t in zip(Xb, yb):
        move = sample_gradient(x, row, t) - sample_gradient(anchor, row, t)
        x = x - p.eta * (move + full + pull * (x - start))
        total += x
    return total / len(yb)


@pytest.mark.parametrize("pull", [0.0, 0.2])
def test_inner_steps(pull):
    rng = np.random.default_rng(0)
    start, anchor, full = rng.normal(size=(3, 3))
    got = vr.inner_mean(X[:40], Y[:40], start, anchor, full, P, pull)
    want = naive_mean(X[:40], Y[:40], start, anchor, full, P, pull)
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_svrg_epochs_on_the_drawn_rows(spark, ws, blob_points):
    draws = sampling.draw_with_replacement(blob_points, 3 * 8, 5, workspace=ws)
    ids = draws.toPandas().sort_values("step")["id"].to_numpy()
    w = np.array([0.1, -0.2, 0.3])
    for e in range(3):
        block = ids[e * 8 : (e + 1) * 8]
        full = brute.gradient(w, X, Y, P, M)
        w = naive_mean(X[block], Y[block], w, w, full, P, 0.0)
    fit = fit_svrg(blob_points, 3, 8, P, seed=5, w0=[0.1, -0.2, 0.3], workspace=ws)
    np.testing.assert_allclose(fit.w, w, atol=1e-10)
    assert [r["w"] for r in fit.model.orderBy("j").collect()] == fit.w.tolist()


@pytest.mark.parametrize("job", [fit_svrg, fit_stratified_svrg])
def test_objective_falls(spark, ws, blob_points, job):
    start = [2.0, -2.0, 1.0]
    fit = job(blob_points, 6, 20, P, seed=1, w0=start, workspace=ws)
    before = brute.objective(np.array(start), X, Y, P, M)
    assert brute.objective(fit.w, X, Y, P, M) < before


def test_block_schedule_by_hand():
    # 10 rows in 3 blocks of 3: the third block would end at 9 < 10, so it is
    # used; 9 rows in 3 blocks: the third would reach the end and is skipped
    assert vr.block_schedule([10, 9], 5, 3) == [
        (0, 0, 3), (0, 3, 3), (0, 6, 3), (1, 0, 3), (1, 3, 3),
    ]
    assert vr.block_schedule([10, 9], 6, 3)[5] == (0, 0, 3)
    assert vr.block_schedule([4], 3, 1) == [(0, 0, 4)] * 3
    with pytest.raises(ValueError):
        vr.block_schedule([2], 1, 3)


def test_block_svrg_by_brute_force(spark, ws, blob_points):
    start = np.array([0.5, 0.5, 0.0])
    fit = fit_block_svrg(
        blob_points, rounds=7, epochs=0, blocks=4, params=P, n_parts=3, seed=2,
        w0=start, workspace=ws,
    )
    from marginspark.operators import placement

    part = placement.random_split(blob_points, 3, 2).toPandas()
    rows = [np.sort(part[part["part"] == k]["id"].to_numpy()) for k in range(3)]
    z = start.copy()
    for k, first, size in vr.block_schedule([len(r) for r in rows], 7, 4):
        at = rows[k][first : first + size]
        full = brute.gradient(z, X, Y, P, M)
        z = naive_mean(X[at], Y[at], start, z, full, P, 0.2)
    np.testing.assert_allclose(fit.w, z, atol=1e-10)
    trace = fit.trace.orderBy("round").collect()
    assert len(trace) == 7 and trace[-1]["w"] == fit.w.tolist()
    loss = brute.objective(start, X, Y, P, M) - 0.5 * start @ start
    assert abs(trace[0]["batch_loss"] - loss) < 1e-10


def test_block_svrg_stops_and_writes_its_trace(spark, ws, blob_points, tmp_path):
    fit = fit_block_svrg(
        blob_points, rounds=2, epochs=5, fraction=0.5, blocks=4, seed=2,
        params=MarginParams(eta=1e-12), batch_scale="batch", workspace=ws,
        sink_dir=str(tmp_path / "t"),
    )
    # a step this small is below the tolerance after one epoch
    assert {r["epoch"] for r in fit.trace.collect()} == {0}
    assert spark.read.parquet(str(tmp_path / "t/trace")).count() == 2


def test_stratified_draws_follow_the_clusters(spark, ws, blob_points):
    draws = vr.stratified_draws(blob_points, 100, 3, 5, fraction=1.0, workspace=ws)
    counts = draws.groupBy("cid").count().toPandas()
    assert 100 <= counts["count"].sum() < 105
    assert draws.agg(F.count_distinct("step")).first()[0] == counts["count"].sum()
