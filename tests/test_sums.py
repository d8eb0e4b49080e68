import numpy as np
import pytest
from pyspark.sql import functions as F

from marginspark.functions import batches as B
from marginspark.operators import dual, placement, primal, sums
from marginspark.params import MarginParams

P = MarginParams()


def whole(batch):
    X = B.matrix(batch["x"])
    return lambda at: X[at].sum(axis=0)


@pytest.fixture(scope="module")
def rows(spark):
    """Keys of very different sizes, one of them null, over nine tasks."""
    rng = np.random.default_rng(4)
    data = [
        (None if i % 11 == 0 else ("hot" if i % 3 else f"k{i % 40}"), rng.normal(size=5).tolist())
        for i in range(3000)
    ]
    return spark.createDataFrame(data, "key string, x array<double>").repartition(9).cache()


def plain(rows):
    out = {}
    for r in rows.collect():
        out[r["key"]] = out.get(r["key"], 0.0) + np.array(r["x"])
    return out


@pytest.mark.parametrize("tasks", [None, 9, 100])
@pytest.mark.parametrize("cells", [1 << 22, 10])
def test_vectors_by_key(spark, rows, monkeypatch, tasks, cells):
    """Few or many partial sums, held long or passed on early."""
    monkeypatch.setattr(sums, "CELLS", cells)
    got = {r["key"]: np.array(r["v"]) for r in sums.vectors_by(rows, "key", whole, tasks).collect()}
    want = plain(rows)
    assert set(got) == set(want) and None in got
    for key, v in want.items():
        np.testing.assert_allclose(got[key], v, atol=1e-10)
    assert sums.vectors_by(rows.where("false"), "key", whole, tasks).isEmpty()


def test_wide_sums_by_key_equal_the_short_ones(spark, rows, monkeypatch):
    weighted = rows.where("key is not null").withColumn("c", F.length("key") - 2.5)
    runs = []
    for limit in (32, 0):
        monkeypatch.setattr(primal, "UNROLL_LIMIT", limit)
        found = primal.weighted_sums_by(weighted, "key", F.col("c"), 5).collect()
        runs.append({r["key"]: r["w"] for r in found})
    assert runs[0].keys() == runs[1].keys()
    for key, w in runs[0].items():
        np.testing.assert_allclose(runs[1][key], w, atol=1e-10)


def test_wide_sums_take_no_vector_apart(spark, rows, monkeypatch):
    monkeypatch.setattr(primal, "UNROLL_LIMIT", 0)
    wide = primal.weighted_sums_by(rows, "key", F.lit(1.0), 5)
    assert "Generate" not in wide._jdf.queryExecution().optimizedPlan().toString()


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("limit", [512, 0])
def test_split_parts_join_nothing(spark, ws, blob_points, monkeypatch, limit):
    """The sums of a step and the solved rows come from scans and exchanges of
    partial sums, however the parts are grouped; so do their answers."""
    from marginspark.operators import damped

    monkeypatch.setattr(damped, "HESSIAN_LIMIT", limit)
    asked = []
    made = sums.vectors_by
    monkeypatch.setattr(sums, "vectors_by", lambda *a: asked.append(made(*a)) or asked[-1])
    state = dual.zero_duals(placement.random_split(blob_points, 7, 3))
    runs = []
    for cells in (1 << 22, 1):
        monkeypatch.setattr(dual, "STATE_CELLS", cells)
        solved = dual.solve_parts(state, P, 200, None, 7, ws, max_part_rows=0)
        assert "Join" not in plan_of(solved)
        runs.append(solved.toPandas().sort_values("id"))
    assert asked
    for df in asked:
        assert "Join" not in plan_of(df) and "Generate" not in plan_of(df)
    np.testing.assert_allclose(runs[0]["zeta"], runs[1]["zeta"], atol=1e-9)
    np.testing.assert_allclose(runs[0]["beta"], runs[1]["beta"], atol=1e-9)
    assert (runs[0]["slot"].to_numpy() == runs[1]["slot"].to_numpy()).all()


def test_no_rows_to_split(spark, ws, blob_points):
    state = dual.zero_duals(blob_points).where("id < 0")
    out = dual._solve_over_tasks(state, P, 200, "global", ws)
    assert out.count() == 0 and out.columns == ["id", "x", "y", "zeta", "beta", "slot", "part"]
