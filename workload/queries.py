"""The registered queries.  Every one runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginspark.functions import margin as M
from marginspark.functions import vectors as V
from marginspark.operators import clustering as C
from marginspark.operators import dual, placement, primal, sampling
from marginspark.params import MarginParams
from marginspark.plans import hierarchy, variance_reduced
from marginspark.sources import schema, sinks, text
from marginspark.sources.text import check_points
from marginspark.workspace import Workspace
from workload import fixtures as fx

PARAMS = MarginParams()
K = 8  # centers of the single-step cluster queries
PARTS = 64
SEED = 7
SIGMA = 0.4

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def _start_centers(points: DataFrame, k: int = K):
    return [r["x"] for r in sampling.first_k(points.select("id", "x"), k, SEED).collect()]


# --- sources -----------------------------------------------------------------


@query
def parse_points(spark, sf_dir):
    parsed = text.parse_lines(fx.order_lines(spark, sf_dir), width=4)
    return parsed.where("reason is null").select(
        *[r6(F.col("x")[j]).alias(f"x{j}") for j in range(4)], "y"
    )


@query
def rejected_lines(spark, sf_dir):
    parsed = text.parse_lines(fx.order_lines(spark, sf_dir), width=4)
    bad = parsed.where("reason is not null")
    return bad.groupBy("reason").agg(F.count("*").alias("n"))


@query
def dims_count(spark, sf_dir):
    return text.dimensions(fx.embeddings(spark, sf_dir))


# --- projections, losses, gradients --------------------------------------------


@query
def label_scaled(spark, sf_dir):
    scaled = fx.embeddings(spark, sf_dir).select(
        "id", F.posexplode(M.label_scaled("x", "y")).alias("j", "v")
    )
    return scaled.select("id", "j", r6("v").alias("v"))


@query
def margin_bands(spark, sf_dir):
    points = fx.lineitem(spark, sf_dir)
    out = primal.band_summary(points, fx.weights(5), PARAMS, points.count())
    return out.select("band", "n", r6("loss").alias("loss"))


@query
def margin_bands_documents(spark, sf_dir):
    points = fx.documents(spark, sf_dir)
    out = primal.band_summary(points, fx.weights(4), PARAMS, points.count())
    return out.select("band", "n", r6("loss").alias("loss"))


@query
def sample_loss(spark, sf_dir):
    w = fx.weights(4)
    loss = M.sample_loss(M.score("x", "y", w), w, PARAMS)
    return fx.orders(spark, sf_dir).select("id", r6(loss).alias("loss"))


@query
def sample_gradient(spark, sf_dir):
    g = M.sample_gradient("x", "y", fx.weights(4), PARAMS)
    rows = fx.orders(spark, sf_dir).select("id", F.posexplode(g).alias("j", "g"))
    return rows.select("id", "j", r6("g").alias("g"))


@query
def full_gradient(spark, sf_dir):
    points = fx.lineitem(spark, sf_dir)
    g = primal.full_gradient(points, fx.weights(5), PARAMS, points.count())
    return g.select("j", r6("g").alias("g"))


@query
def full_gradient_wide(spark, sf_dir):
    points = fx.embeddings(spark, sf_dir)
    g = primal.full_gradient(points, fx.weights(65), PARAMS, points.count())
    return g.select("j", r6("g").alias("g"))


@query
def gradient_at_zero(spark, sf_dir):
    points = fx.lineitem(spark, sf_dir)
    g = primal.full_gradient(points, [0.0] * 5, PARAMS, points.count())
    return g.select("j", r6("g").alias("g"))


@query
def batch_loss(spark, sf_dir):
    points = fx.lineitem(spark, sf_dir)
    out = primal.batch_loss(points, fx.weights(5), PARAMS, points.count())
    return out.select(r6("batch_loss").alias("batch_loss"))


@query
def objective(spark, sf_dir):
    points = fx.lineitem(spark, sf_dir)
    out = primal.objective(points, fx.weights(5), PARAMS, points.count())
    return out.select(r6("objective").alias("objective"))


# --- clusters ------------------------------------------------------------------


def _assigned(points, metric, **kw):
    out = C.assign(points, _start_centers(points), metric, distance="d", **kw)
    return out.select("id", "cid", r6("d").alias("d"))


@query
def assign_linear(spark, sf_dir):
    points = fx.orders(spark, sf_dir).withColumn("x", M.label_scaled("x", "y"))
    return _assigned(points, "linear")


@query
def assign_euclid(spark, sf_dir):
    return _assigned(fx.embeddings(spark, sf_dir), "euclid")


@query
def assign_rbf(spark, sf_dir):
    return _assigned(fx.orders(spark, sf_dir), "rbf")


@query
def cluster_stats(spark, sf_dir):
    points = fx.orders(spark, sf_dir)
    stats = C.cluster_stats(points, _start_centers(points))
    return stats.select("cid", "j", r6("total").alias("total"), "n")


def _steps(spark, sf_dir, steps):
    points = fx.orders(spark, sf_dir)
    centers = _start_centers(points)
    for _ in range(steps):
        centers = C.kmeans_step(points, centers)
    return C.centers_frame(spark, centers).select(
        "cid", F.posexplode("cx").alias("j", "c")
    ).select("cid", "j", r6("c").alias("c"))


@query
def kmeans_step1(spark, sf_dir):
    return _steps(spark, sf_dir, 1)


@query
def kmeans_step2(spark, sf_dir):
    return _steps(spark, sf_dir, 2)


def _clustered(spark, sf_dir):
    points = fx.orders(spark, sf_dir)
    return C.assign(points, _start_centers(points), "euclid")


@query
def cluster_counts(spark, sf_dir):
    return C.cluster_counts(_clustered(spark, sf_dir))


@query
def quotas(spark, sf_dir):
    assigned = _clustered(spark, sf_dir)
    counts = C.cluster_counts(assigned)
    return sampling.quotas(counts, 3000, assigned.count())


@query
def landmark_first(spark, sf_dir):
    picked = C.landmarks(fx.orders(spark, sf_dir), 1, kernel="linear")
    return spark.createDataFrame([(0, picked[0][0])], "pick int, id bigint")


def _picks(spark, sf_dir, k):
    picked = C.landmarks(fx.orders(spark, sf_dir), k)
    rows = [(i, p[0]) for i, p in enumerate(picked)]
    return spark.createDataFrame(rows, "pick int, id bigint")


@query
def landmark_second(spark, sf_dir):
    return _picks(spark, sf_dir, 2)


@query
def landmark_third(spark, sf_dir):
    return _picks(spark, sf_dir, 3)


def _chosen(spark, picked):
    rows = [(i, p[0]) for i, p in enumerate(picked)]
    return spark.createDataFrame(rows, "pick int, id bigint")


@query
def landmarks_rbf(spark, sf_dir):
    return _chosen(spark, C.landmarks(fx.orders(spark, sf_dir), 10))


@query
def landmarks_linear(spark, sf_dir):
    return _chosen(spark, C.landmarks(fx.orders(spark, sf_dir), 4, kernel="linear"))


@query
def landmarks_lower(spark, sf_dir):
    """Linear kernel and the lower triangle of the Gram matrix alone."""
    picked = C.landmarks(fx.orders(spark, sf_dir), 20, kernel="linear", gram="lower")
    return _chosen(spark, picked)


@query
def landmarks_of_sample(spark, sf_dir):
    """Twenty landmarks of a narrow kernel among half of the wide vectors."""
    picked = C.landmarks(fx.embeddings(spark, sf_dir), 20, 0.5, SEED, sigma=SIGMA)
    return _chosen(spark, picked)


@query
def kernel_vectors_sigma(spark, sf_dir):
    points = fx.orders(spark, sf_dir)
    kq = C.kernel_vectors(points, _start_centers(points), sigma=SIGMA)
    rows = kq.select("id", F.posexplode("kq").alias("q", "k"))
    return rows.select("id", "q", r6("k").alias("k"))


def _mapped(spark, sf_dir):
    points = fx.orders(spark, sf_dir)
    return C.feature_map(points, _start_centers(points, 3), "rbf", SIGMA, bias=True)


@query
def rbf_features(spark, sf_dir):
    """Coordinates of all rows in the span of three landmarks, and a bias."""
    rows = _mapped(spark, sf_dir).select("id", F.posexplode("x").alias("j", "v"))
    return rows.select("id", "j", r6("v").alias("v"))


@query
def rbf_dual_two_sweeps(spark, sf_dir):
    """Two sweeps of all parts with the RBF kernel by its feature map."""
    points = placement.random_split(_mapped(spark, sf_dir), PARTS, SEED)
    solved = dual.solve_parts(
        dual.zero_duals(points), PARAMS, points.count(), 1, PARTS, Workspace(spark)
    )
    return _state(solved)


@query
def landmark_scores(spark, sf_dir):
    points = fx.orders(spark, sf_dir)
    first_two = _start_centers(points, 2)
    scores = C.landmark_scores(points, first_two)
    return scores.select("id", r6("score").alias("score"))


@query
def kernel_vectors(spark, sf_dir):
    points = fx.orders(spark, sf_dir)
    kq = C.kernel_vectors(points, _start_centers(points))
    rows = kq.select("id", F.posexplode("kq").alias("q", "k"))
    return rows.select("id", "q", r6("k").alias("k"))


@query
def linear_kernel_vectors(spark, sf_dir):
    points = fx.embeddings(spark, sf_dir)
    kq = C.kernel_vectors(points, _start_centers(points), "linear")
    rows = kq.select("id", F.posexplode("kq").alias("q", "k"))
    return rows.select("id", "q", r6("k").alias("k"))


# --- samples and placement -------------------------------------------------------


@query
def md5_sample(spark, sf_dir):
    return sampling.bernoulli(fx.orders(spark, sf_dir), 0.3, SEED).select("id", "y")


@query
def first_k(spark, sf_dir):
    return sampling.first_k(fx.orders(spark, sf_dir), 20, SEED).select("id", "y")


@query
def random_split(spark, sf_dir):
    return placement.random_split(fx.orders(spark, sf_dir), PARTS, SEED).select(
        "id", "part"
    )


@query
def global_index(spark, sf_dir):
    return placement.global_index(fx.orders(spark, sf_dir)).select("id", "idx")


@query
def local_index(spark, sf_dir):
    split = placement.random_split(fx.orders(spark, sf_dir), PARTS, SEED)
    return placement.local_index(split, "part").select("id", "part", "slot")


@query
def local_index_hot_key(spark, sf_dir):
    """Two keys, one with two thirds of the rows, numbered without a group in
    one task."""
    return placement.local_index(
        fx.orders(spark, sf_dir), "y", max_window_rows=0
    ).select("id", "y", "slot")


@query
def local_index_null_key(spark, sf_dir):
    """A key that is null for a third of the rows, on the distributed path."""
    rows = fx.orders(spark, sf_dir).withColumn("key", F.nullif(F.col("y"), F.lit(1)).cast("string"))
    return placement.local_index(rows, "key", max_window_rows=0).select("id", "key", "slot")


@query
def stratified_deal(spark, sf_dir):
    dealt = placement.stratified_deal(_clustered(spark, sf_dir), "cid", PARTS)
    return dealt.select("id", "cid", "part")


@query
def stratified_deal_rotated(spark, sf_dir):
    dealt = placement.stratified_deal(
        _clustered(spark, sf_dir), "cid", PARTS, rotate=True, max_window_rows=0
    )
    return dealt.select("id", "cid", "part")


@query
def merge_deal(spark, sf_dir):
    split = placement.random_split(fx.orders(spark, sf_dir), PARTS, SEED)
    indexed = placement.local_index(split, "part")
    by_index = placement.merge_deal(indexed, PARTS // 2)
    return by_index.select("id", "part")


@query
def merge_deal_pairwise(spark, sf_dir):
    split = placement.random_split(fx.orders(spark, sf_dir), PARTS, SEED)
    return placement.merge_deal(split, PARTS // 2, "pairwise").select("id", "part")


@query
def part_sizes(spark, sf_dir):
    """Rows per partition after each part was moved to its own partition."""
    split = placement.random_split(fx.orders(spark, sf_dir), PARTS, SEED)
    placed = placement.place(split, PARTS).select(
        F.spark_partition_id().alias("part"), F.col("part").alias("_part")
    )
    return placed.groupBy("part").agg(
        F.count("*").alias("n"), F.count_distinct("_part").alias("n_parts")
    )


# --- dual state --------------------------------------------------------------------


def _duals(spark, sf_dir):
    return fx.synthetic_duals(fx.orders(spark, sf_dir))


@query
def signed_coef(spark, sf_dir):
    coefs = dual.coefficients(_duals(spark, sf_dir))
    return coefs.select("id", r6("coef").alias("coef"))


@query
def support_filter(spark, sf_dir):
    kept = dual.support_vectors(_duals(spark, sf_dir))
    return kept.select("id", r6("zeta").alias("zeta"), r6("beta").alias("beta"))


@query
def recover_w(spark, sf_dir):
    w = primal.recover_weights(_duals(spark, sf_dir), 4)
    return w.select("j", r6("w").alias("w"))


@query
def recover_w_wide(spark, sf_dir):
    duals = fx.synthetic_duals(fx.embeddings(spark, sf_dir))
    return primal.recover_weights(duals, 65).select("j", r6("w").alias("w"))


@query
def first_coordinate(spark, sf_dir):
    points = fx.orders(spark, sf_dir)
    z = dual.first_coordinate(points, PARAMS, points.count())
    return z.select("id", r6("zeta").alias("zeta"))


@query
def gram_product(spark, sf_dir):
    duals = placement.random_split(_duals(spark, sf_dir), PARTS, SEED)
    out = dual.gram_product(duals)
    return out.select(
        "id", "part", r6("diagonal").alias("diagonal"), r6("product").alias("product")
    )


@query
def split_part_optimality(spark, sf_dir):
    """Each part solved over many tasks, with the largest violation of the
    optimality conditions: 0 certifies the unique optimum."""
    points = placement.random_split(fx.orders(spark, sf_dir), 3, SEED)
    m = points.count()
    solved = dual.solve_parts(
        dual.zero_duals(points), PARAMS, m, None, 3, Workspace(spark), max_part_rows=0
    )
    s = dual.gram_product(solved).select("id", F.col("product").alias("s"))
    c = PARAMS.ridge(m)
    g_zeta = F.col("s") + F.col("zeta") * c + F.lit(PARAMS.theta - 1.0)
    g_beta = -F.col("s") + F.col("beta") * (c / PARAMS.mu) + F.lit(PARAMS.theta + 1.0)

    def violation(g, a):
        return F.when(F.col(a) > 0, F.abs(g)).otherwise(F.greatest(-g, F.lit(0.0)))

    worst = F.greatest(violation(g_zeta, "zeta"), violation(g_beta, "beta"))
    return solved.join(s, "id").groupBy("part").agg(
        F.count("*").alias("n"), r6(F.max(worst)).alias("violation")
    )


@query
def dual_two_sweeps(spark, sf_dir):
    """Two sweeps of the local problems of all parts, from the zero state."""
    points = placement.random_split(fx.orders(spark, sf_dir), PARTS, SEED)
    solved = dual.solve_parts(
        dual.zero_duals(points), PARAMS, points.count(), 1, PARTS, Workspace(spark)
    )
    return _state(solved)


@query
def dual_two_sweeps_split(spark, sf_dir):
    """The same sweeps with every part cut into segments over several tasks."""
    points = placement.random_split(fx.orders(spark, sf_dir), PARTS, SEED)
    solved = dual.solve_parts(
        dual.zero_duals(points), PARAMS, points.count(), 1, PARTS, Workspace(spark),
        max_part_rows=max(1, points.count() // PARTS // 3),
    )
    return _state(solved)


def _state(duals):
    return duals.select(
        "id", "part", "slot",
        (F.round("zeta", 9) + F.lit(0.0)).alias("zeta"),
        (F.round("beta", 9) + F.lit(0.0)).alias("beta"),
    )


@query
def random_two_levels(spark, sf_dir):
    """81 parts, then 27 by the place in the old part; one sweep each."""
    policy = hierarchy.Policy(3, "random", 3)
    fit = hierarchy.fit_hierarchy(
        fx.orders(spark, sf_dir), policy, PARAMS, levels=4, sweeps=0, seed=SEED
    )
    return _state(fit.duals)


@query
def cascade_four_levels(spark, sf_dir):
    """8, 4, 2 and 1 parts, support vectors only; two sweeps each."""
    fit = hierarchy.fit_hierarchy(
        fx.embeddings(spark, sf_dir), "cascade", PARAMS, levels=3, sweeps=1, seed=SEED
    )
    return _state(fit.duals)


@query
def divide_conquer_three_levels(spark, sf_dir):
    """9 clusters, 3 clusters, then the support vectors; two sweeps each."""
    policy = hierarchy.Policy(3, "cluster", 1, final_gather=True, kmeans_iterations=2)
    fit = hierarchy.fit_hierarchy(
        fx.embeddings(spark, sf_dir), policy, PARAMS, levels=2, sweeps=1, seed=SEED,
        fraction=1.0,
    )
    return _state(fit.duals)


@query
def stratified_cascade_two_levels(spark, sf_dir):
    """Eight clusters dealt into 64 parts, then 32; one sweep each."""
    policy = hierarchy.Policy(2, "kmeans", 5, support_only=True, kmeans_iterations=2)
    fit = hierarchy.fit_hierarchy(
        fx.orders(spark, sf_dir), policy, PARAMS, levels=6, sweeps=0, seed=SEED,
        fraction=1.0, n_clusters=K,
    )
    return _state(fit.duals)


@query
def distribution_aware_two_levels(spark, sf_dir):
    """Three landmarks, the deal into 64 parts, then 32; one sweep each."""
    policy = hierarchy.Policy(2, "landmarks", 5)
    fit = hierarchy.fit_hierarchy(
        fx.orders(spark, sf_dir), policy, PARAMS, levels=6, sweeps=0, seed=SEED,
        fraction=1.0, n_landmarks=3,
    )
    return _state(fit.duals)


# --- gradient jobs over fixed draws --------------------------------------------------


def _model(spark, w):
    rows = [(j, float(v)) for j, v in enumerate(w)]
    return spark.createDataFrame(rows, "j int, w double").select("j", r6("w").alias("w"))


@query
def svrg_epochs(spark, sf_dir):
    """Three epochs of ten corrected steps over the first rows of a seeded order."""
    points = fx.orders(spark, sf_dir).persist()
    order = Window.orderBy(sampling.md5_key(SEED), "id")
    draws = sampling.first_k(points, 30, SEED).withColumn(
        "step", F.row_number().over(order) - 1
    )
    fit = variance_reduced.run_epochs(
        points, draws, np.array(fx.weights(4)), PARAMS, points.count(), 3, 10
    )
    points.unpersist()
    return _model(spark, fit.w)


@query
def block_svrg_rounds(spark, sf_dir):
    """Two rounds over the first two blocks of the first part."""
    fit = variance_reduced.fit_block_svrg(
        fx.orders(spark, sf_dir), rounds=2, epochs=0, params=PARAMS, seed=SEED,
        w0=fx.weights(4),
    )
    return _model(spark, fit.w)


# --- iterative jobs (no SQL twin; see tests/) -----------------------------------------


@query
def dual_fit(spark, sf_dir):
    points = placement.random_split(fx.orders(spark, sf_dir), PARTS, SEED)
    solved = dual.solve_parts(
        dual.zero_duals(points), PARAMS, points.count(), 30, PARTS, Workspace(spark)
    )
    return solved.select("id", "part", "slot", "zeta", "beta")


@query
def dual_fit_local_scale(spark, sf_dir):
    points = placement.random_split(fx.orders(spark, sf_dir), PARTS, SEED)
    solved = dual.solve_parts(
        dual.zero_duals(points), PARAMS, points.count(), 30, PARTS, Workspace(spark),
        scale="local",
    )
    return solved.select("id", "part", "slot", "zeta", "beta")


def _fit(spark, sf_dir, policy, **kw):
    return hierarchy.fit_hierarchy(
        fx.orders(spark, sf_dir), policy, PARAMS, seed=SEED, **kw
    )


@query
def text_round_trip(spark, sf_dir):
    """The orders as delimited text, written, read and parsed again."""
    lines = fx.orders(spark, sf_dir).select(
        F.concat_ws(",", F.slice("x", 1, F.size("x") - 1), F.col("y").cast("string"))
    )
    ws = Workspace(spark)
    path = f"{ws.root}/text"
    lines.write.text(path)
    points, rejected = text.read_points(spark, path, workspace=ws)
    sums = points.agg(
        F.count("*").alias("n"),
        F.max("id").alias("last_id"),
        F.count_distinct("id").alias("ids"),
        F.sum("y").alias("labels"),
        *[r6(F.sum(F.col("x")[j])).alias(f"x{j}") for j in range(4)],
    )
    return sums.withColumn("rejected", F.lit(rejected.count()).cast("bigint"))


@query
def coefficient_sink(spark, sf_dir):
    """Signed coefficients written to the sink and read back."""
    ws = Workspace(spark)
    coefs = signed_coef(spark, sf_dir).select("id", "coef").withColumn("level", F.lit(3))
    sinks.append_coefs(coefs, ws.root)
    return spark.read.parquet(f"{ws.root}/coef").select("id", "coef")


def _run(spark, sf_dir):
    """Training of 81 and 27 parts, one sweep each, with a folder for its output."""
    ws = Workspace(spark)
    hierarchy.fit_hierarchy(
        fx.orders(spark, sf_dir), hierarchy.Policy(3, "random", 3), PARAMS, levels=4, sweeps=0,
        seed=SEED, sink_dir=f"{ws.root}/out",
    )
    return sinks.RunFolder(spark, f"{ws.root}/out")


@query
def run_history(spark, sf_dir):
    """The committed levels' rows of history, but for the clock."""
    rows = _run(spark, sf_dir).read("history", schema.HISTORY)
    return rows.select("level", "n_parts", "n_rows", "n_support", "max_part_rows")


@query
def run_coefficients(spark, sf_dir):
    """The committed levels' coefficients."""
    rows = _run(spark, sf_dir).read("coef", schema.COEF)
    return rows.select("level", "id", (F.round("coef", 9) + F.lit(0.0)).alias("coef"))


@query
def trace_sink(spark, sf_dir):
    """The weights of each round, written to the sink and read back."""
    ws = Workspace(spark)
    variance_reduced.fit_block_svrg(
        fx.orders(spark, sf_dir), rounds=2, epochs=0, params=PARAMS, seed=SEED,
        w0=fx.weights(4), sink_dir=ws.root,
    )
    rows = spark.read.parquet(f"{ws.root}/trace").select("round", F.posexplode("w").alias("j", "w"))
    return rows.select("round", "j", r6("w").alias("w"))


@query
def weight_text_sink(spark, sf_dir):
    """Weights written as one line of text and read back."""
    path = f"{Workspace(spark).root}/weights"
    sinks.write_weights_text(primal.recover_weights(_duals(spark, sf_dir), 4), path)
    fields = F.split("value", ",")
    rows = spark.read.text(path).select(F.posexplode(fields).alias("j", "w"))
    return rows.select("j", r6(F.col("w").cast("double")).alias("w"))


@query
def dual_two_sweeps_local_scale(spark, sf_dir):
    """Two sweeps of all parts, each with its own number of rows as the scale."""
    points = placement.random_split(fx.orders(spark, sf_dir), PARTS, SEED)
    solved = dual.solve_parts(
        dual.zero_duals(points), PARAMS, points.count(), 1, PARTS, Workspace(spark), scale="local"
    )
    return _state(solved)


@query
def fit_dc(spark, sf_dir):
    return _fit(spark, sf_dir, "divide_conquer", levels=4, fraction=0.1).coef


@query
def fit_random(spark, sf_dir):
    return _fit(spark, sf_dir, "random", levels=4).coef


@query
def fit_cascade(spark, sf_dir):
    return _fit(spark, sf_dir, "cascade").coef


@query
def fit_stratified_cascade(spark, sf_dir):
    return _fit(spark, sf_dir, "stratified_cascade").coef


@query
def fit_distribution_aware(spark, sf_dir):
    return _fit(spark, sf_dir, "distribution_aware").coef


@query
def fit_rbf(spark, sf_dir):
    """Distribution-aware training with a Gaussian kernel."""
    return _fit(spark, sf_dir, "distribution_aware", kernel="rbf", sigma=SIGMA).coef


@query
def history(spark, sf_dir):
    return _fit(spark, sf_dir, "distribution_aware").history


@query
def fit_svrg(spark, sf_dir):
    fit = variance_reduced.fit_svrg(fx.orders(spark, sf_dir), params=PARAMS, seed=SEED)
    return _model(spark, fit.w)


@query
def random_start(spark, sf_dir):
    """The start of a gradient job over the embeddings, one number a feature."""
    _, n = check_points(fx.embeddings(spark, sf_dir))
    w = sampling.start_vector(n, SEED)
    return _model(spark, w)


@query
def fit_svrg_stratified(spark, sf_dir):
    fit = variance_reduced.fit_stratified_svrg(
        fx.orders(spark, sf_dir), params=PARAMS, seed=SEED
    )
    return _model(spark, fit.w)


@query
def fit_svrg_prox(spark, sf_dir):
    fit = variance_reduced.fit_block_svrg(
        fx.orders(spark, sf_dir), params=PARAMS, seed=SEED
    )
    return fit.trace


@query
def stratified_sample(spark, sf_dir):
    draws = variance_reduced.stratified_draws(fx.orders(spark, sf_dir), 3000, SEED)
    return draws.select("step", "id", "cid")


@query
def sample_with_replacement(spark, sf_dir):
    draws = sampling.draw_with_replacement(fx.orders(spark, sf_dir), 3000, SEED)
    return draws.select("step", "id")


@query
def kmeans(spark, sf_dir):
    centers = C.kmeans(fx.orders(spark, sf_dir), 20, 30, 1e-6, 0.5, SEED)
    rows = C.centers_frame(spark, centers).select("cid", F.posexplode("cx").alias("j", "c"))
    return rows.select("cid", "j", r6("c").alias("c"))


@query
def landmarks(spark, sf_dir):
    picked = C.landmarks(fx.orders(spark, sf_dir), 50, 0.5, SEED)
    rows = [(i, p[0], [float(v) for v in p[1]]) for i, p in enumerate(picked)]
    return spark.createDataFrame(rows, "pick int, id bigint, x array<double>")
