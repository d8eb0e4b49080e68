"""Hierarchical dual training: solve parts, merge them, solve again.

The five policies differ only in how rows reach their first part, how many
parts a level has and which rows are carried on, so they share one driver.
"""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginspark.functions import margin as M
from marginspark.functions import vectors as V
from marginspark.operators import clustering, dual, placement, primal
from marginspark.params import MarginParams
from marginspark.sources import schema, sinks
from marginspark.sources.text import check_points
from marginspark.workspace import Workspace, spread


@dataclass(frozen=True)
class Policy:
    """``base ** level`` parts per level, from the given depth down to
    ``last_level``.  ``start`` is the first placement: ``random``, or dealt by
    ``kmeans`` or ``landmarks`` strata, or ``cluster`` for one part per k-means
    cluster, found anew on each level.  ``support_only`` drops rows with a zero
    dual state between levels; ``final_gather`` adds a last level with all
    support vectors in one part."""

    base: int
    start: str
    last_level: int
    support_only: bool = False
    final_gather: bool = False
    kmeans_iterations: int = 30


POLICIES = {
    "divide_conquer": Policy(3, "cluster", 1, final_gather=True),
    "random": Policy(3, "random", 1),
    "cascade": Policy(2, "random", 0, support_only=True),
    "stratified_cascade": Policy(
        2, "kmeans", 0, support_only=True, kmeans_iterations=50
    ),
    "distribution_aware": Policy(2, "landmarks", 2),
}


@dataclass(frozen=True)
class FeatureMap:
    """A kernel as a linear map: landmarks and the width of the kernel."""

    landmarks: tuple[tuple[float, ...], ...]
    sigma: float

    def __call__(self, points: DataFrame) -> DataFrame:
        return clustering.feature_map(points, self.landmarks, "rbf", self.sigma, bias=True)

    def images(self) -> list[list[float]]:
        """The landmarks' own features."""
        return clustering.images(self.landmarks, "rbf", self.sigma, bias=True)

    def image(self) -> clustering.Image:
        """The map of matrices, for tasks."""
        return clustering.Image(self.landmarks, "rbf", self.sigma, bias=True)


def rbf_features(
    points: DataFrame, rank: int = 50, sigma: float = 1.0, fraction: float = 0.5, seed: int = 0,
    workspace: Workspace | None = None,
) -> FeatureMap:
    """A map of at most ``rank`` dimensions and a bias for the RBF kernel, from
    the greedy landmarks of a sample."""
    chosen = clustering.landmarks(
        points, rank, fraction, seed, "rbf", "symmetric", sigma, workspace
    )
    return FeatureMap(tuple(tuple(map(float, x)) for _, x in chosen), sigma)


@dataclass(frozen=True)
class Fit:
    """``coef`` holds the non-zero signed coefficients of every level, ``solved``
    the last level's rows, with the vectors that were given, and ``history`` one
    row per level."""

    coef: DataFrame
    solved: DataFrame
    history: DataFrame
    n: int
    features: FeatureMap | None = None

    @property
    def duals(self) -> DataFrame:
        """The last level's rows, with the mapped features where there is a map."""
        return self.features(self.solved) if self.features else self.solved

    @property
    def last_coef(self) -> DataFrame:
        return dual.coefficients(self.solved)

    @property
    def weights(self) -> DataFrame:
        """Primal weights ``(j, w)`` of the last level, of the mapped features
        where there is a map."""
        return primal.recover_weights(self.duals, self.n)

    def scores(self, points: DataFrame) -> DataFrame:
        """``(id, score)``: what the last level says of any rows ``(id, x)``;
        its sign is the predicted label."""
        w = [0.0] * self.n
        for row in self.weights.collect():  # n components
            w[row["j"]] = row["w"]
        rows = points.select("id", "x")
        rows = self.features(rows) if self.features else rows
        return rows.select("id", V.dot_literal("x", w).alias("score"))


def _first_parts(points, policy, levels, seed, fraction, n_clusters, n_landmarks, ws,
                 landmark_kernel, gram, rotate, sigma, features, image):
    k = policy.base**levels
    if policy.start == "random":
        return placement.random_split(points, k, seed)
    if policy.start == "cluster":
        return points.withColumn("part", F.lit(0))
    if policy.start == "kmeans":
        centers = clustering.kmeans(
            points, n_clusters, policy.kmeans_iterations, 1e-6, fraction, seed, image=image
        )
        assigned = clustering.assign(points, centers, "linear", image=image)
    elif features is not None:
        # Distances between images are those of the kernel.
        assigned = clustering.assign(
            points, features.images(), "euclid", fold=n_clusters, image=image
        )
    else:
        chosen = clustering.landmarks(
            points, n_landmarks, fraction, seed, landmark_kernel, gram, sigma, ws
        )
        assigned = clustering.assign(
            points, [x for _, x in chosen], "rbf", fold=n_clusters
        )
    # The assignment feeds a count and the deal: store it once.
    assigned = ws.save(assigned, "strata")
    return placement.stratified_deal(assigned, "cid", k, rotate, ws).drop("cid")


def fit_hierarchy(
    points: DataFrame,
    policy: str | Policy,
    params: MarginParams = MarginParams(),
    levels: int = 6,
    sweeps: int | None = None,
    seed: int = 0,
    fraction: float = 0.5,
    n_clusters: int = 200,
    n_landmarks: int = 50,
    landmark_kernel: str = "rbf",
    gram: str = "symmetric",
    merge: str = "local_index",
    rotate: bool = False,
    scale: str = "global",
    max_part_rows: int = dual.MAX_PART_ROWS,
    workspace: Workspace | None = None,
    sink_dir: str | None = None,
    kernel: str = "linear",
    sigma: float = 1.0,
    rank: int | None = None,
    resume: bool = False,
) -> Fit:
    """Train by the named policy from ``base ** levels`` parts downwards.

    ``fraction`` is the sample that clustering and landmark selection see.
    Every part is solved to its optimum, or with ``sweeps`` by at most
    ``sweeps + 1`` sweeps, which takes long for parts above ``max_part_rows``.
    With ``sink_dir`` history and coefficients are committed there level by
    level (see ``sinks.RunFolder``), in a folder without another run.
    ``resume=True`` takes a stopped run of the same settings up after its last
    committed level, from the rows that its workspace has stored.

    ``kernel="rbf"`` trains with a Gaussian kernel of width ``sigma``: the linear
    problems over the rows' coordinates in the span of ``rank`` greedy landmarks
    (``n_landmarks`` by default) are the kernel's problems up to what the
    landmarks leave unexplained.  Rows move and are stored with the vectors that
    were given; their coordinates are made in the tasks.
    """
    if kernel not in ("linear", "rbf"):
        raise ValueError(f"unknown kernel {kernel!r}")
    name = policy if isinstance(policy, str) else "custom"
    policy = POLICIES[policy] if isinstance(policy, str) else policy
    if levels < max(policy.last_level, 1 if policy.start == "cluster" else 0):
        raise ValueError(f"{name} needs at least {policy.last_level} levels")
    spark = points.sparkSession
    ws = workspace or Workspace(spark)
    began = time.monotonic()
    if resume and not sink_dir:
        raise ValueError("only a run with a sink_dir can be resumed")
    points = spread(points.select("id", "x", "y"))
    m, n = check_points(points)
    features, image, width = None, None, n
    if kernel == "rbf":
        features = rbf_features(points, rank or n_landmarks, sigma, fraction, seed, ws)
        image = features.image()
        n = image.n
    max_part_rows = dual.part_limit(width, max_part_rows, sweeps, image)

    plan = [(lv, policy.base**lv) for lv in range(levels, policy.last_level - 1, -1)]
    if policy.final_gather:
        plan.append((0, 1))
    run, done = None, []
    if sink_dir:
        settings = {
            "policy": asdict(policy), "params": asdict(params), "levels": levels,
            "sweeps": sweeps, "seed": seed, "fraction": fraction, "n_clusters": n_clusters,
            "n_landmarks": n_landmarks, "landmark_kernel": landmark_kernel, "gram": gram,
            "merge": merge, "rotate": rotate, "scale": scale, "kernel": kernel,
            "sigma": sigma, "rank": rank, "rows": m, "features": n,
        }
        if features:  # of the stored rows, which earlier versions mapped
            settings["width"] = width
        run = sinks.RunFolder(spark, sink_dir)
        done = run.begin(settings, resume)

    def next_level(solved: DataFrame, step: int):
        """Where the rows go next, what is counted on the way, and the number of
        support vectors."""
        last = step == len(plan) - 1
        gathers = policy.final_gather and step == len(plan) - 2
        carried = None
        if not last and (policy.support_only or gathers):
            carried = M.is_support("zeta", "beta")
        state = solved
        if gathers:
            state = placement.gather(solved)
        elif not last and policy.start != "cluster":
            state = placement.merge_deal(solved, plan[step + 1][1], merge)
        counted = dual.part_sizes(state, max_part_rows, carried)
        state = state if carried is None else state.where(carried)
        reassigned = policy.start == "cluster" and not gathers
        return state, None if reassigned else counted, counted.n_support

    table, sizes, coefs, history = None, None, None, []
    if done:
        began -= done[-1].elapsed_ms / 1000.0
        history = [tuple(r) for r in run.read("history", schema.HISTORY).orderBy(F.desc("level")).collect()]
        for c in done:
            stored = spark.read.schema(schema.COEF).parquet(c.coef)
            coefs = stored if coefs is None else coefs.unionByName(stored)
        table = spark.read.schema(schema.DUALS).parquet(done[-1].state)
        state = table
        if len(done) < len(plan):
            state, sizes, _ = next_level(table, len(done) - 1)
    mark = ws.mark()
    if not done:
        state = dual.zero_duals(
            _first_parts(
                points, policy, levels, seed, fraction, n_clusters, n_landmarks, ws,
                landmark_kernel, gram, rotate, sigma, features, image,
            )
        )
    for step, (level, k) in enumerate(plan):
        if step < len(done):
            continue
        if sizes is None:
            if policy.start == "cluster":
                centers = clustering.kmeans(
                    points if table is None else table, k, policy.kmeans_iterations,
                    1e-6, fraction, seed + level, image=image,
                )
                found = clustering.assign(state, centers, "euclid", image=image)
                state = found.withColumn("part", F.col("cid")).drop("cid")
            if policy.start in ("cluster", "random"):
                # counted and solved, and dearer than a scan to make: store it
                # once; rows that were dealt come from a stored table already
                state = ws.save(state, f"level{level}-in")
            sizes = dual.part_sizes(state, max_part_rows)
        solved = dual.solve_parts(
            state, params, m, sweeps, k, ws, scale, max_part_rows, sizes, store=False,
            image=image,
        )
        fresh = ws.save(solved, f"level{level}")
        level_coef = ws.save(
            dual.coefficients(fresh).select(F.lit(level).alias("level"), "id", "coef"),
            "coef",
        )
        elapsed = int((time.monotonic() - began) * 1000)
        # the input, sorted copies and trial states of this level
        ws.release(mark, fresh, level_coef)
        mark = ws.mark()
        solved_sizes, before, table = sizes, table, fresh
        state, sizes, n_support = next_level(fresh, step)
        history.append(
            (name, level, solved_sizes.n_parts, solved_sizes.n_rows, n_support,
             solved_sizes.max_part_rows, solved_sizes.n_split_parts, elapsed)
        )
        coefs = level_coef if coefs is None else coefs.unionByName(level_coef)
        if run:
            row = spark.createDataFrame(history[-1:], schema.HISTORY)
            run.commit(
                level_coef, row, sinks.Commit(level, ws.path(fresh), ws.path(level_coef), elapsed)
            )
        # nothing needs the level before any more, a resumed run neither
        ws.drop(before)
    points.unpersist()
    return Fit(coefs, table, spark.createDataFrame(history, schema.HISTORY), n, features)
