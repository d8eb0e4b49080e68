"""Headline timings: one JSON line.  BENCH_SF_DIR and BENCH_CPUS select the data
and the cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marginspark.operators import dual
from marginspark.params import MarginParams
from marginspark.plans.hierarchy import fit_hierarchy
from marginspark.plans.variance_reduced import fit_block_svrg, fit_stratified_svrg, fit_svrg
from marginspark.workspace import Workspace
from workload import fixtures as fx
from workload.queries import QUERIES
from workload.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
PARAMS = MarginParams()
SPARSE = MarginParams(lam=1e7)
SEED = 7


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def one_part(spark, sf_dir):
    """All rows as one problem by sweeps in one task: the unscaled training
    that the hierarchical jobs are compared with."""
    points = fx.orders(spark, sf_dir)
    solved = dual.solve_parts(
        dual.zero_duals(points), PARAMS, points.count(), 30, 1, Workspace(spark),
        max_part_rows=1 << 40,
    )
    consume(solved)


def one_part_split(spark, sf_dir):
    """The same problem to its optimum over many tasks."""
    points = fx.orders(spark, sf_dir)
    solved = dual.solve_parts(
        dual.zero_duals(points), PARAMS, points.count(), None, 1, Workspace(spark),
        max_part_rows=0,
    )
    consume(solved)


def hierarchy(policy, params=PARAMS, **kw):
    def run(spark, sf_dir):
        fit = fit_hierarchy(fx.orders(spark, sf_dir), policy, params, seed=SEED, **kw)
        levels = fit.history.orderBy("elapsed_ms").collect()
        name = policy + ("_sweeps" if kw.get("sweeps") else "")
        LEVELS[name + ("" if params is PARAMS else "_sparse")] = [
            {k: r[k] for k in ("level", "n_parts", "n_rows", "n_support", "elapsed_ms")}
            for r in levels
        ]

    return run


LEVELS: dict[str, list] = {}
JOBS = {
    "full_gradient": lambda s, d: consume(QUERIES["full_gradient"](s, d)),
    "full_gradient_wide": lambda s, d: consume(QUERIES["full_gradient_wide"](s, d)),
    "batch_loss": lambda s, d: consume(QUERIES["batch_loss"](s, d)),
    "margin_bands": lambda s, d: consume(QUERIES["margin_bands"](s, d)),
    "assign_rbf": lambda s, d: consume(QUERIES["assign_rbf"](s, d)),
    "cluster_stats": lambda s, d: consume(QUERIES["cluster_stats"](s, d)),
    "stratified_deal": lambda s, d: consume(QUERIES["stratified_deal"](s, d)),
    "recover_w": lambda s, d: consume(QUERIES["recover_w"](s, d)),
    "dual_fit_64_parts": lambda s, d: consume(QUERIES["dual_fit"](s, d)),
    "one_part_sweeps": one_part,
    "one_part_over_tasks": one_part_split,
    "fit_distribution_aware": hierarchy("distribution_aware"),
    "fit_distribution_aware_sweeps": hierarchy("distribution_aware", sweeps=30),
    "fit_stratified_cascade": hierarchy("stratified_cascade"),
    "fit_cascade": hierarchy("cascade"),
    # a heavy loss: most rows end inside the band and drop out
    "fit_cascade_sparse": hierarchy("cascade", SPARSE),
    "fit_random": hierarchy("random", levels=4),
    "fit_divide_conquer": hierarchy("divide_conquer", levels=4, fraction=0.1),
    "fit_svrg": lambda s, d: fit_svrg(fx.orders(s, d), params=PARAMS, seed=SEED),
    "fit_stratified_svrg": lambda s, d: fit_stratified_svrg(
        fx.orders(s, d), 30, 100, params=PARAMS, seed=SEED
    ),
    "fit_block_svrg": lambda s, d: fit_block_svrg(
        fx.orders(s, d), 20, 10, params=PARAMS, seed=SEED
    ),
}


def main() -> None:
    spark = local_session(CPUS, "bench")
    # start the JVM code paths and the Python workers before the clock runs
    consume(QUERIES["full_gradient_wide"](spark, SF_DIR))
    times = {}
    for name in sys.argv[1:] or JOBS:
        began = time.perf_counter()
        JOBS[name](spark, SF_DIR)
        times[name] = round(time.perf_counter() - began, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    out = {
        "metric": "total seconds of the headline jobs",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "cpus": CPUS,
        "levels": LEVELS,
    }
    if "one_part_sweeps" in times and "fit_distribution_aware" in times:
        out["one_part_over_hierarchical"] = round(
            times["one_part_sweeps"] / times["fit_distribution_aware"], 3
        )
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
