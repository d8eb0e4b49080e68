"""Variance-reduced stochastic gradient jobs for linear models.

Per epoch or round one job: a distributed pass gives the full gradient, whose sums
go to the grouped map that takes the inner steps over a parameter-sized set of
sampled rows, and ``n`` numbers come back to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginspark.functions import batches as B
from marginspark.functions import margin as M
from marginspark.operators import clustering, placement, primal, sampling
from marginspark.params import MarginParams
from marginspark.sources import schema, sinks
from marginspark.sources.text import check_points
from marginspark.workspace import Workspace, widen


@dataclass(frozen=True)
class LinearFit:
    model: DataFrame
    trace: DataFrame
    w: np.ndarray


def _start(n: int, w0: Sequence[float] | None, seed: int) -> np.ndarray:
    if w0 is None:
        return sampling.start_vector(n, seed)
    if len(w0) != n:
        raise ValueError(f"w0 has {len(w0)} numbers, the points have {n}")
    return np.array(w0, dtype=float)


def _model(spark, w: np.ndarray) -> DataFrame:
    return spark.createDataFrame(
        [(j, float(v)) for j, v in enumerate(w)], schema.MODEL
    )


def inner_mean(X, y, start, anchor, full, p: MarginParams, pull: float = 0.0):
    """Mean of the iterates of one pass of corrected steps over the rows, in
    order.  ``pull`` ties the iterate to where it started.

    A step is ``x -= eta * (grad(x) - grad(anchor) + full + pull * (x - start))``
    with the sample gradients; their norm terms leave ``x - anchor``.
    """
    S = X * y[:, None]
    at_anchor = B.slope(S @ anchor, p).tolist()
    c_low, c_high = 2.0 * p.loss_weight(1.0), 2.0 * p.loss_weight(1.0) * p.mu
    shrink = 1.0 - p.eta * (1.0 + pull)
    drift = p.eta * (anchor + pull * np.asarray(start) - full)
    x = np.array(start, dtype=float)
    total = np.zeros_like(x)
    for row, known in zip(S, at_anchor):
        s = float(row @ x)
        if s < p.low:
            slope = c_low * (s - p.low)
        elif s > p.high:
            slope = c_high * (s - p.high)
        else:
            slope = 0.0
        x = shrink * x + drift - (p.eta * (slope - known)) * row
        total += x
    return total / len(X)


def _run_block(
    rows: DataFrame, start, anchor, batch: DataFrame, m: float, p, pull=0.0
) -> np.ndarray:
    """The full gradient of ``batch`` at ``anchor`` and the inner steps over
    ``rows`` in ``step`` order, in one job: the gradient's ``n`` sums meet the
    block's rows in the task that takes the steps."""

    def run(table: pa.Table) -> pa.Table:
        block = table.filter(pc.is_valid(table["step"])).sort_by("step")
        if not len(block):
            return pa.table([B.vectors(np.zeros((0, len(anchor))))], names=["w"])
        sums = table.filter(pc.is_valid(table["j"]))
        full = np.array(anchor, dtype=float)
        np.add.at(full, np.asarray(sums["j"]), B.numbers(sums["g"]))
        mean = inner_mean(
            B.matrix(block["x"]), B.numbers(block["y"]), start, anchor, full, p, pull
        )
        return pa.table([B.vectors(mean[None, :])], names=["w"])

    sums = primal.loss_gradient(batch, anchor, p, m).select("j", "g")
    out = (
        rows.select("x", "y", F.col("step").cast("bigint").alias("step"))
        .unionByName(sums, allowMissingColumns=True)
        .groupBy(F.lit(0).alias("block"))
        .applyInArrow(run, "w array<double>")
        .collect()
    )
    if not out:
        raise ValueError("a block without rows")
    return np.array(out[0]["w"], dtype=float)


def run_epochs(
    points: DataFrame,
    draws: DataFrame,
    w: np.ndarray,
    p: MarginParams,
    m: float,
    epochs: int,
    steps: int,
) -> LinearFit:
    """Per epoch the full gradient at ``w`` and ``steps`` corrected steps over
    that epoch's draws; the mean iterate is the next ``w``."""
    spark, trace = points.sparkSession, []
    for epoch in range(epochs):
        block = draws.where(
            (F.col("step") >= epoch * steps) & (F.col("step") < (epoch + 1) * steps)
        )
        w = _run_block(block, w, w, points, m, p)
        trace.append((epoch, 0, w.tolist(), None))
    return LinearFit(_model(spark, w), spark.createDataFrame(trace, schema.TRACE), w)


def fit_svrg(
    points: DataFrame,
    epochs: int = 20,
    steps: int = 10,
    params: MarginParams = MarginParams(),
    seed: int = 0,
    w0: Sequence[float] | None = None,
    workspace: Workspace | None = None,
) -> LinearFit:
    """``epochs * steps`` rows are drawn uniformly with replacement up front."""
    ws = workspace or Workspace(points.sparkSession)
    mark = ws.mark()
    points = widen(points.select("id", "x", "y")).persist()
    try:
        m, n = check_points(points)
        draws = sampling.draw_with_replacement(points, epochs * steps, seed, None, ws)
        draws = sampling.with_rows(points, draws, ws)
        return run_epochs(points, draws, _start(n, w0, seed), params, m, epochs, steps)
    finally:
        points.unpersist()
        ws.release(mark)


def stratified_draws(
    points: DataFrame,
    total: int,
    seed: int = 0,
    n_clusters: int = 20,
    iterations: int = 30,
    fraction: float = 0.5,
    workspace: Workspace | None = None,
) -> DataFrame:
    """``(id, cid, step)``: draws in proportion to the k-means clusters of
    label-scaled features."""
    ws = workspace or Workspace(points.sparkSession)
    scaled = M.label_scaled("x", "y")
    centers = clustering.kmeans(
        points, n_clusters, iterations, 1e-6, fraction, seed, scaled
    )
    # read three times, and two numbers per row: store the assignment once
    assigned = ws.save(
        clustering.assign(points, centers, "linear", x=scaled).select("id", "cid"),
        "strata",
    )
    draws = sampling.draw_with_replacement(assigned, total, seed, "cid", ws)
    ws.drop(assigned)
    return draws


def fit_stratified_svrg(
    points: DataFrame,
    epochs: int = 30,
    steps: int = 100,
    params: MarginParams = MarginParams(),
    seed: int = 0,
    w0: Sequence[float] | None = None,
    n_clusters: int = 20,
    workspace: Workspace | None = None,
) -> LinearFit:
    """As :func:`fit_svrg`, with the draws stratified by cluster and shuffled."""
    ws = workspace or Workspace(points.sparkSession)
    mark = ws.mark()
    points = widen(points.select("id", "x", "y")).persist()
    try:
        m, n = check_points(points)
        draws = stratified_draws(points, epochs * steps, seed, n_clusters, workspace=ws)
        draws = sampling.with_rows(points, draws, ws)
        return run_epochs(points, draws, _start(n, w0, seed), params, m, epochs, steps)
    finally:
        points.unpersist()
        ws.release(mark)


def block_schedule(
    part_sizes: Sequence[int], rounds: int, blocks: int
) -> list[tuple[int, int, int]]:
    """``(part, first row, row count)`` per round.

    A part of ``length`` rows has blocks of ``size = length // blocks`` rows, of
    which the first ``max(1, ceil(length / size) - 1)`` are used.  The blocks of
    the leading parts that have any are taken in order, over and over.
    """
    turn: list[tuple[int, int, int]] = []
    for part, length in enumerate(part_sizes):
        size = length // blocks
        if not size:
            break
        used = max(1, -(-length // size) - 1)
        turn += [(part, i * size, size) for i in range(used)]
        if len(turn) >= rounds:
            break
    if not turn:
        raise ValueError(f"part 0 has fewer than {blocks} rows")
    return [turn[i % len(turn)] for i in range(rounds)]


def fit_block_svrg(
    points: DataFrame,
    rounds: int = 20,
    epochs: int = 10,
    fraction: float = 1.0,
    blocks: int = 20,
    pull: float = 0.2,
    params: MarginParams = MarginParams(),
    n_parts: int | None = None,
    rows_per_part: int = 100_000,
    seed: int = 0,
    w0: Sequence[float] | None = None,
    batch_scale: str = "global",
    workspace: Workspace | None = None,
    sink_dir: str | None = None,
) -> LinearFit:
    """Per epoch (at most ``epochs + 1``) a fresh batch is sampled; each round
    takes the batch gradient at the anchor and one pass over the next block,
    with the iterate pulled towards the epoch's start.  ``batch_scale`` divides
    the gradient by the row count of all data (``global``) or of the batch.
    Without ``n_parts`` a batch has as many parts as hold ``rows_per_part`` rows
    each; the parts decide which rows a block has."""
    if batch_scale not in ("global", "batch"):
        raise ValueError(f"unknown batch_scale {batch_scale!r}")
    spark = points.sparkSession
    ws = workspace or Workspace(spark)
    points = widen(points.select("id", "x", "y")).persist()
    try:
        m, n = check_points(points)
        w = _start(n, w0, seed)
        # parts of bounded size, so that a block fits a task at any scale
        parts = n_parts or max(1, -(-int(m * min(fraction, 1.0)) // rows_per_part))
        trace: list[tuple] = []
        for epoch in range(epochs + 1):
            sample = sampling.bernoulli(points, fraction, seed + epoch)
            if sample is not points:
                sample = sample.persist()  # every round reads it
            batch = placement.random_split(sample, parts, seed)
            # The schedule visits at most one new part per round.
            visited = batch.where(F.col("part") <= rounds)
            counts = dict(visited.groupBy("part").count().collect())
            sizes = [counts.get(i, 0) for i in range(min(parts, rounds + 1))]
            plan = block_schedule(sizes, rounds, blocks)
            size_m = batch.count() if batch_scale == "batch" else m
            schedule = spark.createDataFrame(
                [(i, *entry) for i, entry in enumerate(plan)],
                "round int, part int, _start bigint, _size bigint",
            )
            place = Window.partitionBy("part").orderBy("id")
            slot = (F.row_number().over(place) - 1).alias("slot")
            reach = max(part for part, _, _ in plan)
            # one row per round: a parameter-sized table
            rows = ws.save(
                visited.where(F.col("part") <= reach)
                .select("x", "y", "part", slot)
                .join(F.broadcast(schedule), "part")
                .where("slot >= _start and slot < _start + _size")
                .select("round", "x", "y", F.col("slot").alias("step")),
                "blocks",
            )
            loss = primal.batch_loss(batch, w, params, size_m).first()[0]
            z = w.copy()
            for i in range(rounds):
                block = rows.where(F.col("round") == i)
                z = _run_block(block, w, z, batch, size_m, params, pull)
                trace.append((epoch, i, z.tolist(), float(loss)))
            ws.drop(rows)
            if sample is not points:
                sample.unpersist()
            moved = float(np.linalg.norm(z - w))
            w = z
            if moved < params.tol:
                break
        frame = spark.createDataFrame(trace, schema.TRACE)
        if sink_dir:
            sinks.append_trace(frame, sink_dir)
        return LinearFit(_model(spark, w), frame, w)
    finally:
        points.unpersist()
