"""Plain numpy forms of the problems, dense and slow."""

import numpy as np


def objective(w, X, y, p, m):
    s = y * (X @ w)
    c = p.lam / (m * (1 - p.theta) ** 2)
    low, high = np.maximum(p.low - s, 0), np.maximum(s - p.high, 0)
    return 0.5 * w @ w + c * (low**2).sum() + c * p.mu * (high**2).sum()


def gradient(w, X, y, p, m):
    s = y * (X @ w)
    c = 2 * p.lam / (m * (1 - p.theta) ** 2)
    slope = np.where(s < p.low, c * (s - p.low), 0) + np.where(
        s > p.high, c * p.mu * (s - p.high), 0
    )
    return w + (slope * y) @ X


def hessian(X, y, p, m):
    S = X * y[:, None]
    Q, c, one = S @ S.T, m * (1 - p.theta) ** 2 / (2 * p.lam), np.eye(len(y))
    return np.block([[Q + c * one, -Q], [-Q, Q + c / p.mu * one]])


def dual_value(a, H, p):
    q = np.r_[np.full(len(a) // 2, p.theta - 1), np.full(len(a) // 2, p.theta + 1)]
    return 0.5 * a @ H @ a + q @ a


def dense_descent(X, y, p, m, sweeps, start=None, values=None):
    """Cyclic projected descent with the matrix written out."""
    N = len(y)
    H = hessian(X, y, p, m)
    a = np.zeros(2 * N) if start is None else start.copy()
    q = np.r_[np.full(N, p.theta - 1), np.full(N, p.theta + 1)]
    for _ in range(sweeps + 1):
        old = a.copy()
        for i in range(2 * N):
            a[i] = max(0.0, a[i] - (H[i] @ a + q[i]) / H[i, i])
        if values is not None:
            values.append(dual_value(a, H, p))
        if np.linalg.norm(a - old) < p.tol:
            break
    return a[:N], a[N:]


def primal_optimum(X, y, p, m):
    w = np.zeros(X.shape[1])
    c = p.ridge(m)
    for _ in range(200):
        s = y * (X @ w)
        curve = ((s < p.low) + p.mu * (s > p.high)) / c
        H = np.eye(len(w)) + (X * curve[:, None]).T @ X
        step = -np.linalg.solve(H, gradient(w, X, y, p, m))
        while objective(w + step, X, y, p, m) > objective(w, X, y, p, m) + 1e-14:
            step /= 2
        w = w + step
        if np.abs(step).max() < 1e-13:
            break
    return w
