"""Train from delimited text: ``spark-submit --py-files ... marginspark/train.py``.

Writes below the output folder: ``weights`` (one line), ``rejected`` lines, and
``history`` and ``coef`` per level, or the ``trace`` of a gradient job.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from marginspark.params import MarginParams
from marginspark.plans import variance_reduced as vr
from marginspark.plans.hierarchy import POLICIES, fit_hierarchy
from marginspark.sources import sinks
from marginspark.sources.text import read_points
from marginspark.workspace import Workspace

GRADIENT_JOBS = ("svrg", "stratified_svrg", "block_svrg")


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="marginspark.train", description=__doc__)
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument(
        "--job", default="distribution_aware", choices=[*POLICIES, *GRADIENT_JOBS]
    )
    p.add_argument("--separator", default=",")
    p.add_argument("--width", type=int, help="fields per line; the most frequent if left out")
    p.add_argument("--seed", type=int, default=0)
    for name, default in vars(MarginParams()).items():
        p.add_argument(f"--{name}", type=float, default=default)
    h = p.add_argument_group("hierarchical jobs")
    h.add_argument("--levels", type=int, default=6)
    h.add_argument("--sweeps", type=int, default=-1, help="negative: to the optimum")
    h.add_argument("--fraction", type=float, default=0.5)
    h.add_argument("--clusters", type=int, default=200)
    h.add_argument("--landmarks", type=int, default=50)
    h.add_argument("--kernel", choices=("linear", "rbf"), default="linear")
    h.add_argument("--sigma", type=float, default=1.0)
    h.add_argument("--rank", type=int, help="dimensions of the kernel's feature map")
    h.add_argument("--resume", action="store_true", help="go on after the last committed level")
    g = p.add_argument_group("gradient jobs")
    g.add_argument("--epochs", type=int, default=20)
    g.add_argument("--steps", type=int, default=10, help="steps or rounds per epoch")
    g.add_argument("--batch", type=float, default=1.0)
    g.add_argument("--blocks", type=int, default=20)
    g.add_argument("--pull", type=float, default=0.2)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("marginspark").getOrCreate()
    params = MarginParams(**{name: getattr(a, name) for name in vars(MarginParams())})
    if a.resume and a.job not in POLICIES:
        raise ValueError(f"{a.job} cannot be resumed")
    if not a.resume:
        sinks.require_empty(spark, a.output)
    ws = Workspace(spark)
    points, rejected = read_points(spark, a.input, a.separator, a.width, ws)
    rejected.write.mode("overwrite").parquet(f"{a.output}/rejected")
    common = {"params": params, "seed": a.seed, "workspace": ws}
    if a.job in POLICIES:
        fit = fit_hierarchy(
            points, a.job, levels=a.levels, fraction=a.fraction,
            sweeps=None if a.sweeps < 0 else a.sweeps, n_clusters=a.clusters,
            n_landmarks=a.landmarks, sink_dir=a.output, kernel=a.kernel, sigma=a.sigma,
            rank=a.rank, resume=a.resume, **common,
        )
        model = fit.weights
    else:
        if a.job == "block_svrg":
            fit = vr.fit_block_svrg(
                points, a.steps, a.epochs, a.batch, a.blocks, a.pull, **common
            )
        else:
            job = vr.fit_svrg if a.job == "svrg" else vr.fit_stratified_svrg
            fit = job(points, a.epochs, a.steps, **common)
        sinks.append_trace(fit.trace, a.output)
        model = fit.model
    sinks.write_weights_text(model, f"{a.output}/weights")


if __name__ == "__main__":
    main()
