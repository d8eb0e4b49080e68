"""Local dual problems: one margin-distribution QP per part.

With ``u = sum(y * (zeta - beta) * x)`` over a part, ``c = params.ridge(m)`` and
margin ``s = y * (x . u)``, the part's problem is strictly convex and its
gradients are

    d/d zeta = s + c * zeta + theta - 1,    d/d beta = -s + (c / mu) * beta + theta + 1

so no Gram matrix is ever formed.  A part whose rows fit a task is solved by
cyclic projected coordinate descent inside a grouped map.  A larger part is
never gathered.  Its optimum is the optimum of the equivalent problem in ``u``,
``n`` unknowns, which damped steps over partial sums find (see ``damped``), and
from which each row's ``zeta`` and ``beta`` follow as column expressions.  Where
a number of sweeps is asked for instead, its segments are visited in turn and
hand ``u`` on, which is the same visit of row after row, and as slow.  So the
size of a part picks the plan and never the answer.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginspark.functions import batches as B
from marginspark.functions import margin as M
from marginspark.functions import vectors as V
from marginspark.operators import clustering, damped, placement, primal, sums
from marginspark.params import MarginParams
from marginspark.sources import schema
from marginspark.workspace import Workspace

# Parts above this many rows, or numbers in their vectors, are solved over many
# tasks.  A task holds the numbers of one part, some 100 bytes a row beside its
# vectors, and matrices of ``KEPT_CELLS`` numbers.
MAX_PART_ROWS = 4_000_000
MAX_PART_CELLS = 20_000_000
KEPT_CELLS = 1 << 23

# Rows of a segment where a part is visited over several tasks, at most.
MAX_SEGMENT_ROWS = 100_000

# Rows visited together, and rows that leave a task together.
_CHUNK = 64
_BATCH = 16_384


def zero_duals(points: DataFrame) -> DataFrame:
    """Attach the zero dual state."""
    zero = F.lit(0.0)
    return points.select(
        "id", "x", "y", zero.alias("zeta"), zero.alias("beta"),
        F.lit(0).alias("slot"),
        (F.col("part") if "part" in points.columns else F.lit(0)).alias("part"),
    )


# --- one part in one task ----------------------------------------------------


_BELOW = np.tril(np.ones((_CHUNK, _CHUNK)), -1)


class _Chunk:
    """Some rows that are visited together.

    Visiting them in turn is a triangular system as soon as it is known which
    rows end above zero.  The last visit's answer is the guess; the solution
    shows which rows it was wrong for, and the first of those is right in the
    next try, so this ends with the moves of the row-by-row visit.  The matrices
    are kept from visit to visit (``keep``) or made anew.
    """

    def __init__(self, X: np.ndarray, y: np.ndarray, at: slice, keep: bool) -> None:
        self.X, self.y, self.at, self.keep = X, y, at, keep
        self.known = self._made() if keep else None
        self.guess: dict[float, tuple[np.ndarray, np.ndarray | None]] = {}

    def _made(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = self.X[self.at] * self.y[self.at][:, None]
        gram = rows @ rows.T
        return rows, gram * _BELOW[: len(rows), : len(rows)], gram.diagonal().copy()

    def matrices(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The label-scaled rows, their products below the diagonal and on it."""
        return self.known or self._made()

    def moves(self, sign, old, g, d, lower) -> np.ndarray:
        above, inverse = self.guess.get(sign, (None, None))
        for _ in range(len(old) + 1):
            if inverse is None:
                above = old > 0.0 if above is None else above
                # with no row above zero the system is the identity
                right = -old
                if above.any():
                    system = np.where(above[:, None], lower, 0.0)
                    np.fill_diagonal(system, np.where(above, d, 1.0))
                    if self.keep:
                        inverse = np.linalg.inv(system)
                    else:
                        right = np.linalg.solve(system, np.where(above, -g, -old))
            moves = right if inverse is None else inverse @ np.where(above, -g, -old)
            ends = old * d - (g + lower @ moves) > 0.0
            if (ends == above).all():
                break
            above, inverse = ends, None
        self.guess[sign] = (above, inverse)
        return np.where(above, np.maximum(moves, -old), -old)


def _chunks(X: np.ndarray, y: np.ndarray, again: bool = True) -> list[_Chunk]:
    """All rows in order; the first chunks keep their matrices, where they are
    visited ``again``."""
    kept = KEPT_CELLS // (3 * _CHUNK * _CHUNK) if again else 0
    return [
        _Chunk(X, y, slice(i, i + _CHUNK), i < kept * _CHUNK) for i in range(0, len(X), _CHUNK)
    ]


def _visit(chunks, a, u, sign, ridge, shift):
    """Update ``a`` once in row order; returns the moved ``u`` and the square of
    the move."""
    moved = 0.0
    for chunk in chunks:
        old = a[chunk.at]
        rows, lower, own = chunk.matrices()
        g = sign * (rows @ u) + ridge * old + shift
        if not ((old > 0.0) | (g < 0.0)).any():
            continue
        moves = chunk.moves(sign, old, g, own + ridge, lower)
        a[chunk.at] = old + moves
        u = u + sign * (moves @ rows)
        moved += float(moves @ moves)
    return u, moved


def _finite(X: np.ndarray, y: np.ndarray) -> None:
    if not all(np.isfinite(X[i : i + _BATCH]).all() for i in range(0, len(X), _BATCH)) or not np.isfinite(y).all():
        raise ValueError("the points are not finite; check them for NaN")


def descend(X, y, zeta, beta, p: MarginParams, m: float, sweeps: int):
    """At most ``sweeps + 1`` sweeps over zeta, then beta, from a warm start;
    stops when a sweep moves the state by less than ``tol``."""
    _finite(X, y)
    zeta, beta = zeta.astype(float).copy(), beta.astype(float).copy()
    u = ((zeta - beta) * y) @ X
    c = p.ridge(m)
    chunks = _chunks(X, y, sweeps > 0)
    for _ in range(sweeps + 1):
        u, first = _visit(chunks, zeta, u, 1.0, c, p.theta - 1.0)
        u, second = _visit(chunks, beta, u, -1.0, c / p.mu, p.theta + 1.0)
        if math.sqrt(first + second) < p.tol:
            break
    return zeta, beta


def settle(X, y, zeta, beta, p: MarginParams, m: float, image=None, cells: int = MAX_PART_CELLS):
    """The optimum that the sweeps converge to.  Images of up to ``cells`` numbers
    are held, those of larger parts are made block by block in each pass."""
    c, state = p.ridge(m), (zeta - beta) * y
    if image and len(X) * image.n <= cells:
        X, image = image(X), None
    if image:
        start = sum(state[at] @ Z for at, Z in damped.blocks(X, image))
        w = damped.optimum(X, y, start, c, p, image)
        s = y * np.concatenate([Z @ w for _, Z in damped.blocks(X, image)])
    else:
        s = y * (X @ damped.optimum(X, y, state @ X, c, p))
    return np.maximum(p.low - s, 0.0) / c, np.maximum(s - p.high, 0.0) * p.mu / c


def _parts(batches):
    """``(part, ids, X, y, zeta, beta)`` of each part in turn, of rows in the
    order of the part: the numbers of one part are held."""
    held: list[pa.RecordBatch] = []

    def taken():
        whole = pa.Table.from_batches(held)
        held.clear()
        state = [B.numbers(whole[c]).astype(float) for c in ("y", "zeta", "beta")]
        return whole["part"][0], whole["id"].combine_chunks(), B.matrix(whole["x"]), *state

    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch["part"].fill_null(-1).to_numpy()
        if held and held[-1]["part"].fill_null(-1)[-1].as_py() != part[0]:
            yield taken()
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        for a, b in zip(cuts, cuts[1:]):
            if a:
                yield taken()
            held.append(batch.slice(a, b - a))
    if held:
        yield taken()


def _solve_in_tasks(duals, tasks, p, m, sweeps, scale, image=None):
    """Each part streams to one task, sorted by id on the way."""

    def solve(batches):
        for part, ids, X, y, zeta, beta in _parts(batches):
            n = len(X)
            state = y, zeta, beta, p, n if scale == "local" else m
            if sweeps is None:
                zeta, beta = settle(X, *state, image)
            else:
                zeta, beta = descend(image(X) if image else X, *state, sweeps)
            for i in range(0, n, _BATCH):
                at = slice(i, min(i + _BATCH, n))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(i, _BATCH), B.vectors(X[at]), pa.array(y[at].astype("int32")),
                        pa.array(zeta[at]), pa.array(beta[at]),
                        pa.array(np.arange(at.start, at.stop, dtype="int32")),
                        pa.array([part.as_py()] * (at.stop - i), pa.int32()),
                    ],
                    ["id", "x", "y", "zeta", "beta", "slot", "part"],
                )

    rows = placement.place(duals.select("id", "x", "y", "zeta", "beta", "part"), tasks)
    rows = rows.sortWithinPartitions("part", F.asc_nulls_last("id"))
    return rows.mapInArrow(solve, schema.DUALS)


# --- one part over many tasks ------------------------------------------------

# Numbers in the states that travel with the tasks: parts beyond them wait for
# their turn.
STATE_CELLS = 1 << 22


def _images(batch: pa.RecordBatch, image) -> np.ndarray:
    """The vectors of a batch, or their images."""
    X = B.matrix(batch["x"])
    return image(X) if image else X


def _step_sums(states: dict, p: MarginParams, second: bool, image=None):
    """What a step needs of the rows, at each part's ``w``; ``states`` has the
    ``(w, ridge)`` of the parts that are not settled."""

    def prepare(batch: pa.RecordBatch):
        S, part = _images(batch, image), B.numbers(batch["part"])
        S = S * B.numbers(batch["y"])[:, None]

        def add(at: np.ndarray) -> np.ndarray:
            (w, c), own = states[int(part[at[0]])], S[at]
            return damped.sums(own, own @ w, c, p, second)

        return add

    return prepare


def _advanced(trials: dict):
    """One step per part, from its trial and its sums ``v``."""

    def run(batches):
        for batch in batches:
            for part, v in zip(batch["part"].to_pylist(), batch["v"]):
                trial = damped.advance(trials[part], v.values.to_numpy())
                row = [pa.array([part], pa.int32()), pa.array([pickle.dumps(trial)])]
                yield pa.RecordBatch.from_arrays(row, ["part", "trial"])

    return run


def _state_at(solution: dict, p: MarginParams, image=None):
    """The dual state of rows whose part is solved by ``w``."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            S, part = _images(batch, image), B.numbers(batch["part"])
            s, c = np.zeros(len(S)), np.zeros(len(S))
            for key in np.unique(part):
                at = part == key
                w, ridge = solution[int(key)]
                s[at], c[at] = S[at] @ w, ridge
            s *= B.numbers(batch["y"])
            fresh = {
                "zeta": pa.array(np.maximum(p.low - s, 0.0) / c),
                "beta": pa.array(np.maximum(s - p.high, 0.0) * p.mu / c),
            }
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([fresh.get(k, batch[k]) for k in names], names)

    return run


def _groups(parts: list[int], cells: int) -> list[list[int]]:
    """Parts in order, as many together as their states allow."""
    many = max(1, STATE_CELLS // cells)
    return [parts[i : i + many] for i in range(0, len(parts), many)]


def _optima(rows, ridge: dict, p: MarginParams, n: int, tasks: int, image=None) -> dict:
    """``(w, ridge)`` at the optimum of each part of ``ridge``, one job a step."""
    second = n <= damped.HESSIAN_LIMIT
    coef = M.signed_coef("y", "zeta", "beta")
    sums_by = primal.weighted_sums_by(rows, "part", coef, n, image)
    warm = {r["part"]: r["w"] for r in sums_by.collect()}
    trials = {k: damped.Trial(np.array(warm[k], dtype=float)) for k in ridge}
    narrow = rows.select("part", "x", "y")
    for _ in range(damped.MAX_PASSES):
        open_ = {k: t for k, t in trials.items() if not t.done}
        if not open_:
            return {k: (t.w, ridge[k]) for k, t in trials.items()}
        states = {k: (t.w, ridge[k]) for k, t in open_.items()}
        own = narrow if len(open_) == len(trials) else narrow.where(F.col("part").isin(list(open_)))
        totals = sums.vectors_by(own, "part", _step_sums(states, p, second, image), tasks)
        for r in totals.mapInArrow(_advanced(open_), "part int, trial binary").collect():
            trials[r["part"]] = pickle.loads(r["trial"])
    raise RuntimeError("the steps did not settle")


def _solve_over_tasks(duals, p, m, scale, ws, store=True, image=None):
    """Solve every part of ``duals`` without gathering any.

    The number of parts is set by parameters; a part's state is a few vectors
    (``MEMORY`` pairs of them for wide rows) and travels with the tasks.  The
    steps scan the rows where they are; once solved, rows are sorted for their
    slots and, with ``store``, stored, so that readers join nothing."""
    first = duals.select(F.size("x")).first()
    if first is None:
        return duals.select("id", "x", "y", "zeta", "beta", "slot", "part")
    n = image.n if image else first[0]
    counts = dict(duals.groupBy("part").count().collect())
    ridge = {k: p.ridge(many if scale == "local" else m) for k, many in counts.items()}
    tasks = duals.rdd.getNumPartitions()
    vectors = 4 if n <= damped.HESSIAN_LIMIT else 4 + 2 * damped.MEMORY
    solution = {}
    for group in _groups(sorted(ridge), n * vectors):
        whole = len(group) == len(ridge)
        own = duals if whole else duals.where(F.col("part").between(group[0], group[-1]))
        solution |= _optima(own, {k: ridge[k] for k in group}, p, n, tasks, image)
    # Sorted before they are solved, so that the sort's own sample of the rows
    # takes no solving; the states of a group travel with its tasks.
    placed = placement.local_index(
        duals.select("id", "x", "y", "part"), "part", workspace=ws, max_window_rows=0
    )
    zero = F.lit(0.0)
    placed = placed.select(
        "id", "x", "y", zero.alias("zeta"), zero.alias("beta"),
        F.col("slot").cast("int").alias("slot"), "part",
    )
    out = None
    for group in _groups(sorted(ridge), n * vectors):
        whole = len(group) == len(ridge)
        own = placed if whole else placed.where(F.col("part").between(group[0], group[-1]))
        states = {k: solution[k] for k in group}
        solved = own.mapInArrow(_state_at(states, p, image), schema.DUALS)
        out = solved if out is None else out.unionByName(solved)
    return ws.save(out, "split-parts") if store else out


# --- sweeps of one part over many tasks ----------------------------------------

_VISITED = schema.DUALS + ", u array<double>, moved double"


def _segment_visit(open_: dict, sign: float, p: MarginParams, image=None):
    """One visit of the rows of a segment of each open part; ``open_`` has each
    part's ``u`` and ridge.  The first row brings back ``u`` and the move."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("slot")
        part = table["part"][0].as_py()
        name = "zeta" if sign > 0 else "beta"
        u, moved = None, None
        if part in open_:
            a = B.numbers(table[name]).astype(float).copy()
            u, c = open_[part]
            ridge = c if sign > 0 else c / p.mu
            shift = p.theta - 1.0 if sign > 0 else p.theta + 1.0
            chunks = _chunks(_images(table, image), B.numbers(table["y"]).astype(float), False)
            u, moved = _visit(chunks, a, u, sign, ridge, shift)
            at = table.schema.get_field_index(name)
            table = table.set_column(at, name, pa.array(a))
        rest = [None] * (table.num_rows - 1)
        sums = pa.array([None if u is None else u.tolist(), *rest], pa.list_(pa.float64()))
        return table.append_column("u", sums).append_column(
            "moved", pa.array([moved, *rest], pa.float64())
        )

    return run


def _sweep_over_tasks(duals, p, m, sweeps, scale, ws, limit, image=None):
    """``descend`` for parts of any size: segments of ``limit`` rows in turn,
    those of different parts side by side.  The driver holds one ``u`` per part."""
    limit = min(max(1, limit), MAX_SEGMENT_ROWS)
    rows = ws.save(
        placement.local_index(duals, "part", workspace=ws, max_window_rows=0)
        .withColumn("slot", F.col("slot").cast("int"))
        .withColumn("_segment", F.floor(F.col("slot") / limit).cast("int")),
        "split-parts",
    )
    columns = [c for c in rows.columns if c != "_segment"]
    shape = rows.agg(F.max("_segment").alias("last"), F.max(F.size("x")).alias("n")).first()
    if shape["last"] is None:
        return rows.select(*columns)
    n = image.n if image else shape["n"]
    sums = primal.weighted_sums_by(rows, "part", M.signed_coef("y", "zeta", "beta"), n, image)
    counts = dict(rows.groupBy("part").count().collect())
    ridge = {k: p.ridge(many if scale == "local" else m) for k, many in counts.items()}
    u = {r["part"]: np.array(r["w"], dtype=float) for r in sums.collect()}
    open_ = {k: (u.get(k, np.zeros(n)), ridge[k]) for k in counts}
    tables = [
        ws.save(rows.where(F.col("_segment") == j).select(*columns), f"segment{j}")
        for j in range(shape["last"] + 1)
    ]
    for _ in range(sweeps + 1):
        moved = dict.fromkeys(open_, 0.0)
        for sign in (1.0, -1.0):
            for j, table in enumerate(tables):
                own = table.select(*columns).groupBy("part")
                fresh = ws.save(
                    own.applyInArrow(_segment_visit(open_, sign, p, image), _VISITED), f"segment{j}"
                )
                for r in fresh.where("moved is not null").select("part", "u", "moved").collect():
                    open_[r["part"]] = (np.array(r["u"]), ridge[r["part"]])
                    moved[r["part"]] += r["moved"]
                ws.drop(table)
                tables[j] = fresh
        open_ = {k: v for k, v in open_.items() if math.sqrt(moved[k]) >= p.tol}
        if not open_:
            break
    out = tables[0].select(*columns)
    for table in tables[1:]:
        out = out.unionByName(table.select(*columns))
    return out.select("id", "x", "y", "zeta", "beta", "slot", "part")


# --- all parts ---------------------------------------------------------------


@dataclass(frozen=True)
class Sizes:
    n_parts: int
    n_rows: int
    max_part_rows: int
    n_split_parts: int
    n_support: int


def part_sizes(
    duals: DataFrame, max_part_rows: int, carried: Column | None = None
) -> Sizes:
    """Sizes of the parts, of ``carried`` rows only if given, and the number of
    support vectors among all rows.  One pass over the narrow columns."""
    carried = F.lit(True) if carried is None else carried
    counts = duals.groupBy("part").agg(
        F.count_if(carried).alias("n"),
        F.count_if(M.is_support("zeta", "beta")).alias("support"),
    )
    total = counts.agg(
        F.count_if(F.col("n") > 0),
        F.coalesce(F.sum("n"), F.lit(0)),
        F.coalesce(F.max("n"), F.lit(0)),
        F.count_if(F.col("n") > max_part_rows),
        F.coalesce(F.sum("support"), F.lit(0)),
    )
    return Sizes(*total.first())


def part_limit(
    n: int, max_part_rows: int = MAX_PART_ROWS, sweeps: int | None = None, image=None
) -> int:
    """Rows of vectors of length ``n`` that a task may hold, with their images
    where it holds those of a whole part: sweeps visit the rows again and again."""
    held = n + image.n if image and sweeps is not None else n
    return min(max_part_rows, max(1, MAX_PART_CELLS // max(1, held)))


def solve_parts(
    duals: DataFrame,
    p: MarginParams,
    m: float,
    sweeps: int | None,
    k: int,
    workspace: Workspace,
    scale: str = "global",
    max_part_rows: int = MAX_PART_ROWS,
    sizes: Sizes | None = None,
    store: bool = True,
    image: clustering.Image | None = None,
) -> DataFrame:
    """Solve each part's problem from its warm start; ``slot`` becomes the row's
    place in its part.  ``k`` is the number of parts.

    ``scale`` takes the loss weight from all ``m`` rows or from the part's own
    row count (``"local"``).  Parts above ``max_part_rows`` are solved to the
    optimum over many tasks; the others take at most ``sweeps + 1`` sweeps, or
    as many as it takes to the same optimum when ``sweeps`` is None.  A caller
    that stores the result itself needs no ``store`` of the larger parts.  With an
    ``image`` the problems are those of the vectors' images, while rows keep
    their vectors: images are made in the tasks, never moved or stored.
    """
    if scale not in ("global", "local"):
        raise ValueError(f"unknown scale {scale!r}")
    if sizes is None:
        first = duals.select(F.size("x")).first()
        n = first[0] or 1 if first else 1
        max_part_rows = part_limit(n, max_part_rows, sweeps, image)
        sizes = part_sizes(duals, max_part_rows)
    # One task per part, or several small parts to a task when there are many.
    cores = duals.sparkSession.sparkContext.defaultParallelism
    tasks = min(k, max(4 * cores, -(-2 * sizes.n_rows // max(max_part_rows, 1))))
    if not sizes.n_split_parts:
        return _solve_in_tasks(duals, tasks, p, m, sweeps, scale, image)
    def over_tasks(rows: DataFrame) -> DataFrame:
        if sweeps is None:
            return _solve_over_tasks(rows, p, m, scale, workspace, store, image)
        return _sweep_over_tasks(rows, p, m, sweeps, scale, workspace, max_part_rows, image)

    if sizes.n_split_parts == sizes.n_parts:
        return over_tasks(duals)
    # At most n_rows / max_part_rows rows; the stored size picks the join.
    large = workspace.save(
        duals.groupBy("part").count().where(F.col("count") > max_part_rows).select("part"),
        "large-parts",
    )
    small = duals.join(large, "part", "left_anti")
    # scanned in every step
    big = workspace.save(
        duals.join(large, "part", "left_semi").select(*duals.columns), "large-rows"
    )
    return _solve_in_tasks(
        small.select(*duals.columns), tasks, p, m, sweeps, scale, image
    ).unionByName(over_tasks(big))


def coefficients(duals: DataFrame) -> DataFrame:
    """Signed non-zero coefficients ``(id, coef)``."""
    coef = M.signed_coef("y", "zeta", "beta")
    return duals.select("id", coef.alias("coef")).where("coef <> 0")


def support_vectors(duals: DataFrame) -> DataFrame:
    return duals.where(M.is_support("zeta", "beta"))


def gram_product(duals: DataFrame) -> DataFrame:
    """The signed Gram matrix of each part times ``zeta - beta``, per row, with
    the diagonal entry: ``(id, part, diagonal, product)``.

    The matrix has a row and a column per row of the part; its product needs
    only the part's ``u``, one aggregate, joined back by part.
    """
    n = duals.select(F.size("x")).first()[0]
    sums = primal.weighted_sums_by(
        duals, "part", M.signed_coef("y", "zeta", "beta"), n
    )
    return duals.join(sums, "part").select(
        "id", "part", V.dot("x", "x").alias("diagonal"),
        (F.col("y") * V.dot("x", "w")).alias("product"),
    )


def first_coordinate(points: DataFrame, p: MarginParams, m: float) -> DataFrame:
    """What one zeta update makes of each row alone, from the zero state."""
    step = F.lit(p.low) / (V.dot("x", "x") + F.lit(p.ridge(m)))
    return points.select("id", F.greatest(step, F.lit(0.0)).alias("zeta"))


def dual_objective(duals: DataFrame, p: MarginParams, m: float, n: int) -> float:
    """Value of the dual problem of the whole state taken as one part."""
    w = primal.to_vector(primal.recover_weights(duals, n), n)
    c = p.ridge(m)
    row = (
        F.col("zeta") * F.col("zeta") * (c / 2.0)
        + F.col("beta") * F.col("beta") * (c / (2.0 * p.mu))
        + F.col("zeta") * (p.theta - 1.0)
        + F.col("beta") * (p.theta + 1.0)
    )
    total = duals.agg(F.sum(row)).first()[0] or 0.0
    return float(0.5 * w @ w + total)
