import os

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from marginspark import POLICIES, MarginParams, fit_hierarchy
from marginspark.operators import dual, primal
from marginspark.plans import hierarchy
from marginspark.sources import schema, sinks
from marginspark.workspace import Workspace
from tests import brute
from tests.conftest import SMALL, blobs, frame
from workload import fixtures as fx

P = MarginParams()
SHAPE = dict(levels=3, sweeps=30, seed=3, n_clusters=6, n_landmarks=6)


@pytest.fixture(scope="module")
def orders(spark):
    return fx.orders(spark, SMALL).cache()


@pytest.mark.parametrize("policy", ["stratified_cascade", "divide_conquer"])
def test_rows_are_stored_once_a_level(blob_points, ws, monkeypatch, policy):
    """Neither rows that were dealt nor solved rows of large parts twice."""
    names, plain = [], ws.save
    monkeypatch.setattr(ws, "save", lambda df, name: names.append(name) or plain(df, name))
    few = 50 if policy == "divide_conquer" else dual.MAX_PART_ROWS
    shape = SHAPE | {"levels": 1, "sweeps": None}
    fit = fit_hierarchy(blob_points, policy, P, workspace=ws, max_part_rows=few, **shape)
    assert "split-parts" not in names
    assert policy == "divide_conquer" or "level1-in" not in names
    whole = fit_hierarchy(blob_points, policy, P, **shape)
    a, b = (f.duals.orderBy("id").toPandas() for f in (fit, whole))
    np.testing.assert_allclose(a[["id", "slot", "zeta", "beta"]], b[["id", "slot", "zeta", "beta"]], atol=1e-6)


def test_tables_of_few_tasks_are_read_by_many(spark, ws):
    rows = spark.range(3_000_000).coalesce(1).select("id", F.rand(3).alias("v"))
    path = ws.path(ws.save(rows, "rows"))
    files = [f for f in os.listdir(path) if f.endswith(".parquet")]
    assert len(files) == 1
    assert pq.read_metadata(f"{path}/{files[0]}").num_row_groups > 1


def levels_of(fit):
    return fit.history.orderBy(F.desc("level")).collect()


@pytest.mark.parametrize("policy", sorted(POLICIES))
def test_levels_parts_and_rows(spark, ws, blob_points, policy):
    fit = fit_hierarchy(blob_points, policy, P, workspace=ws, **SHAPE)
    rule = POLICIES[policy]
    rows = levels_of(fit)
    depths = [r["level"] for r in rows]
    last = 0 if rule.final_gather else rule.last_level
    assert depths == list(range(3, last - 1, -1))
    assert rows[0]["n_rows"] == 200
    for r in rows:
        assert r["n_parts"] <= rule.base ** r["level"]
        # a coefficient can be zero only for a row outside the support
        assert fit.coef.where(F.col("level") == r["level"]).count() <= r["n_support"]
    for before, after in zip(rows, rows[1:]):
        dropped = rule.support_only or (rule.final_gather and after["level"] == 0)
        want = before["n_support"] if dropped else before["n_rows"]
        assert after["n_rows"] == want
    assert rows[-1]["n_parts"] == (1 if last == 0 else rule.base**last)
    state = fit.duals.toPandas()
    assert state["id"].is_unique
    assert (state["zeta"] >= 0).all() and (state["beta"] >= 0).all()
    assert fit.last_coef.count() == fit.coef.where(F.col("level") == last).count()


@pytest.mark.parametrize("policy", ["cascade", "stratified_cascade", "divide_conquer"])
def test_the_last_part_is_solved_to_its_optimum(spark, ws, policy):
    """The last level holds the surviving rows in one part."""
    X, y = blobs(200, gap=3.0)
    fit = fit_hierarchy(
        frame(spark, X, y), policy, MarginParams(tol=1e-12), workspace=ws,
        **{**SHAPE, "sweeps": 3000, "levels": 2},
    )
    w = primal.to_vector(fit.weights, 3)
    kept = np.sort(fit.duals.toPandas()["id"].to_numpy())
    np.testing.assert_allclose(
        w, brute.primal_optimum(X[kept], y[kept], P, 200), atol=1e-6
    )


@pytest.mark.parametrize("policy", sorted(POLICIES))
def test_split_parts_change_the_way_not_the_problem(spark, ws, blob_points, policy):
    """Solving the same levels in tasks and over many tasks agrees."""
    shape = {**SHAPE, "levels": 2, "sweeps": None}
    a = fit_hierarchy(blob_points, policy, P, workspace=ws, **shape)
    b = fit_hierarchy(blob_points, policy, P, workspace=ws, max_part_rows=40, **shape)
    assert sum(r["n_split_parts"] for r in levels_of(b)) > 0
    wa, wb = (primal.to_vector(f.weights, 3) for f in (a, b))
    np.testing.assert_allclose(wa, wb, atol=1e-6)


def test_same_seed_same_result(spark, ws, orders):
    runs = [
        fit_hierarchy(df, "distribution_aware", P, workspace=ws, **SHAPE)
        .last_coef.toPandas().sort_values("id")
        for df in (orders, orders.repartition(3))
    ]
    assert (runs[0]["id"].to_numpy() == runs[1]["id"].to_numpy()).all()
    np.testing.assert_allclose(runs[0]["coef"], runs[1]["coef"], atol=1e-12)


def test_deal_balances_parts_and_deeper_sweeps_help(spark, ws, orders):
    fit = fit_hierarchy(orders, "distribution_aware", P, workspace=ws, **SHAPE)
    for r in levels_of(fit):
        assert r["max_part_rows"] <= r["n_rows"] / r["n_parts"] + 6 * 2 ** (3 - r["level"])


@pytest.mark.parametrize("merge", ["local_index", "pairwise"])
def test_merge_modes_keep_all_rows(spark, ws, blob_points, merge):
    fit = fit_hierarchy(blob_points, "random", P, workspace=ws, merge=merge, **SHAPE)
    assert fit.duals.count() == 200
    assert [r["n_parts"] for r in levels_of(fit)] == [27, 9, 3]


def test_only_the_result_stays_stored(spark, ws, blob_points, tmp_path):
    """The last level, and the coefficients of all levels."""
    fit_hierarchy(
        blob_points, "stratified_cascade", P, workspace=ws, max_part_rows=60, **{**SHAPE, "sweeps": None}
    )
    names = sorted(
        f.parent.name.split("-", 1)[1] for f in tmp_path.rglob("_SUCCESS")
    )
    assert names == ["coef"] * 4 + ["level0"]


def test_too_shallow_levels_are_refused(blob_points):
    for policy, levels in (("distribution_aware", 1), ("random", 0), ("divide_conquer", 0)):
        with pytest.raises(ValueError):
            fit_hierarchy(blob_points, policy, P, levels=levels)


def test_sinks_hold_every_level(spark, ws, blob_points, tmp_path):
    folder = str(tmp_path / "out")
    fit = fit_hierarchy(
        blob_points, "cascade", P, workspace=ws, sink_dir=folder, **SHAPE
    )
    history = spark.read.parquet(f"{folder}/history")
    assert history.count() == 4 == fit.history.count()
    coefs = spark.read.parquet(f"{folder}/coef")
    assert coefs.count() == fit.coef.count()
    assert coefs.groupBy("level").count().count() == 4
    times = [r["elapsed_ms"] for r in history.orderBy(F.desc("level")).collect()]
    assert times == sorted(times)


def test_support_vectors_drop_nan_free(spark, ws, blob_points):
    state = dual.zero_duals(blob_points).withColumn("zeta", F.lit(0.5))
    assert dual.support_vectors(state).count() == 200
    assert dual.support_vectors(dual.zero_duals(blob_points)).count() == 0


class Stopped(Exception):
    pass


@pytest.mark.parametrize("policy", ["cascade", "divide_conquer", "distribution_aware"])
def test_a_stopped_run_goes_on_after_its_last_level(
    spark, ws, blob_points, tmp_path, monkeypatch, policy
):
    """Same coefficients as without the stop; what the stopped level left behind
    is never read."""
    shape = {**SHAPE, "levels": 3 if policy == "distribution_aware" else 2}
    whole = fit_hierarchy(blob_points, policy, P, workspace=ws, **shape)
    folder, solve, done = str(tmp_path / "out"), dual.solve_parts, []

    def stops(*args, **kw):
        done.append(1)
        if len(done) == 2:
            raise Stopped
        return solve(*args, **kw)

    monkeypatch.setattr(dual, "solve_parts", stops)
    with pytest.raises(Stopped):
        fit_hierarchy(blob_points, policy, P, workspace=ws, sink_dir=folder, **shape)
    monkeypatch.setattr(dual, "solve_parts", solve)
    run = sinks.RunFolder(spark, folder)
    assert [c.level for c in run.commits()] == [shape["levels"]]
    next_one = shape["levels"] - 1
    for table in ("coef", "history"):
        spark.range(3).write.parquet(f"{folder}/{table}/level={next_one}")
    assert run.read("history", schema.HISTORY).count() == 1
    first = run.read("coef", schema.COEF)
    assert {r["level"] for r in first.select("level").distinct().collect()} == {shape["levels"]}

    monkeypatch.setattr(hierarchy.clustering, "landmarks", None)  # not chosen again
    fit = fit_hierarchy(blob_points, policy, P, workspace=Workspace(spark, str(tmp_path / "new")),
                        sink_dir=folder, resume=True, **shape)
    want = whole.coef.toPandas().sort_values(["level", "id"])
    for got in (fit.coef, run.read("coef", schema.COEF)):
        got = got.toPandas().sort_values(["level", "id"])
        assert (got[["level", "id"]].to_numpy() == want[["level", "id"]].to_numpy()).all()
        np.testing.assert_allclose(got["coef"], want["coef"], atol=1e-9)
    columns = ["solver", "level", "n_parts", "n_rows", "n_support", "max_part_rows"]
    for history in (fit.history, run.read("history", schema.HISTORY)):
        assert sorted(history.select(*columns).collect()) == sorted(whole.history.select(*columns).collect())
    np.testing.assert_allclose(
        primal.to_vector(fit.weights, 3), primal.to_vector(whole.weights, 3), atol=1e-9
    )
    # a run that is through is only read
    monkeypatch.setattr(dual, "solve_parts", None)
    again = fit_hierarchy(blob_points, policy, P, workspace=ws, sink_dir=folder, resume=True, **shape)
    assert again.coef.count() == len(want) and again.duals.count() == whole.duals.count()


def test_runs_are_not_mixed(spark, ws, blob_points, tmp_path):
    folder, shape = str(tmp_path / "out"), {**SHAPE, "levels": 1}
    fit_hierarchy(blob_points, "random", P, workspace=ws, sink_dir=folder, **shape)
    with pytest.raises(FileExistsError):
        fit_hierarchy(blob_points, "random", P, workspace=ws, sink_dir=folder, **shape)
    with pytest.raises(ValueError, match="other settings"):
        fit_hierarchy(blob_points, "random", P, workspace=ws, sink_dir=folder, resume=True,
                      **{**shape, "seed": 4})
    with pytest.raises(ValueError, match="sink_dir"):
        fit_hierarchy(blob_points, "random", P, workspace=ws, resume=True, **shape)
    spark.range(1).write.parquet(str(tmp_path / "used/history"))
    with pytest.raises(FileExistsError):
        fit_hierarchy(blob_points, "random", P, workspace=ws, sink_dir=str(tmp_path / "used"), **shape)
