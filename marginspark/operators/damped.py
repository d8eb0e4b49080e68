"""Damped steps towards the optimum of one part's problem in its weights.

    f(w) = |w|^2 / 2 + sum(low^2 + mu * high^2) / (2 c)

with ``low`` and ``high`` the distances of a row's margin below and above the
band.  A step needs only sums over the part's rows, so the same rule serves a
part held in one task and a part spread over many.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np

from marginspark.params import MarginParams

# Vectors up to this length use the exact second derivative, ``n * n`` sums per
# part; wider ones build the step from the last few gradients.
HESSIAN_LIMIT = 512
MEMORY = 12
MAX_PASSES = 1000


@functools.lru_cache(maxsize=4)
def _upper(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n)


def sums(S, s, c, p: MarginParams, second: bool) -> np.ndarray:
    """Loss, gradient and (``second``) Hessian sums of label-scaled rows ``S``
    with margins ``s``, as one vector, of the Hessian the upper triangle; the
    norm term is not part of them."""
    low, high = np.maximum(p.low - s, 0.0), np.maximum(s - p.high, 0.0)
    loss = ((low**2 + p.mu * high**2) / (2.0 * c)).sum()
    out = [[loss], ((p.mu * high - low) / c) @ S]
    if second:
        curve = ((low > 0) + p.mu * (high > 0)) / c
        out.append(((S * curve[:, None]).T @ S)[_upper(S.shape[1])])
    return np.concatenate(out)


@dataclass
class Trial:
    """``w`` is to be tried next; ``base`` is the last accepted point, where the
    value was ``f`` and the gradient ``g``."""

    w: np.ndarray
    base: np.ndarray | None = None
    f: float = 0.0
    g: np.ndarray | None = None
    direction: np.ndarray | None = None
    step: float = 1.0
    done: bool = False
    moves: list = field(default_factory=list)
    changes: list = field(default_factory=list)


def _remembered(g, moves, changes):
    """Minus the inverse curvature of the remembered moves, applied to ``g``."""
    q, used = g.copy(), []
    for s, d in zip(reversed(moves), reversed(changes)):
        a = (s @ q) / (s @ d)
        q -= a * d
        used.append(a)
    if moves:
        q *= (moves[-1] @ changes[-1]) / (changes[-1] @ changes[-1])
    for s, d, a in zip(moves, changes, reversed(used)):
        q += (a - (d @ q) / (s @ d)) * s
    return -q


def advance(t: Trial, v: np.ndarray) -> Trial:
    """The next trial, from the sums at ``t.w``."""
    n = len(t.w)
    f, g = float(v[0] + 0.5 * t.w @ t.w), v[1 : n + 1] + t.w
    if not np.isfinite(f):
        raise ValueError("the loss is not finite; check the points for NaN")
    if t.base is not None:
        promised = 1e-4 * t.step * float(t.g @ t.direction)
        if f > t.f + promised + 1e-13 * abs(t.f):
            step = 0.5 * t.step
            return Trial(
                t.base + step * t.direction, t.base, t.f, t.g, t.direction, step,
                False, t.moves, t.changes,
            )
    moves, changes = list(t.moves), list(t.changes)
    size = 1e-9 * (1.0 + np.abs(t.w).max())
    if len(v) > n + 1:
        curve = np.zeros((n, n))
        curve[_upper(n)] = v[n + 1 :]
        curve = curve + np.triu(curve, 1).T + np.eye(n)
        direction = -np.linalg.solve(curve, g)
        done = np.abs(direction).max() <= size
    else:
        if t.base is not None and (t.w - t.base) @ (g - t.g) > 0.0:
            moves = (moves + [t.w - t.base])[-MEMORY:]
            changes = (changes + [g - t.g])[-MEMORY:]
        direction = _remembered(g, moves, changes)
        if not moves:
            direction /= max(1.0, float(np.linalg.norm(g)))
        # the norm term bounds the distance to the optimum by |g|
        done = np.linalg.norm(g) <= size
        if done:
            direction = np.zeros(n)
    return Trial(
        t.w + direction, t.w, f, g, direction, 1.0, bool(done), moves, changes
    )


# Rows of which sums are taken at once, and numbers of images made at once.
_ROWS, _IMAGE_CELLS = 1 << 16, 1 << 17


def blocks(X: np.ndarray, image=None):
    """The rows, or their images made block by block, with their places."""
    rows = max(1, _IMAGE_CELLS // image.n) if image else _ROWS
    for i in range(0, len(X), rows):
        at = slice(i, i + rows)
        yield at, image(X[at]) if image else X[at]


def optimum(
    X: np.ndarray, y: np.ndarray, start: np.ndarray, c: float, p: MarginParams, image=None
) -> np.ndarray:
    """The weights that solve the part's problem, for rows held in memory; with an
    ``image`` that of their images, which each pass makes anew."""
    trial, second = Trial(start), len(start) <= HESSIAN_LIMIT
    for _ in range(MAX_PASSES):
        total = 0.0
        for at, Z in blocks(X, image):
            S = Z * y[at, None]
            total = total + sums(S, S @ trial.w, c, p, second)
        trial = advance(trial, total)
        if trial.done:
            return trial.w
    raise RuntimeError("the steps did not settle")
