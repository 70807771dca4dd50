"""Small dense kernels on the driver: everything here is features by features."""

from __future__ import annotations

import numpy as np


def positive_diagonal(r: np.ndarray) -> np.ndarray:
    """An upper factor with a non-negative diagonal; the canonical form of R."""
    sign = np.where(np.diag(r) < 0, -1.0, 1.0)
    return r * sign[:, None] + 0.0


def upper(a: np.ndarray, n: int | None = None) -> np.ndarray:
    """The n x n upper factor of a's QR, padded with zero rows, in canonical form."""
    n = a.shape[1] if n is None else n
    r = np.linalg.qr(a, mode="r") if a.size else np.zeros((0, n))
    out = np.zeros((n, n))
    out[: min(len(r), n)] = np.triu(r)[:n]
    return positive_diagonal(out)


def householder_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Thin Q and R with a non-negative diagonal."""
    q, r = np.linalg.qr(a)
    sign = np.where(np.diag(r) < 0, -1.0, 1.0)
    return q * sign, r * sign[:, None]


def givens(a: float, b: float) -> tuple[float, float]:
    """cos and sin of the rotation that turns (a, b) into (hypot, 0)."""
    h = np.hypot(a, b)
    return (1.0, 0.0) if h == 0 else (a / h, b / h)


def givens_upper(a: np.ndarray) -> np.ndarray:
    """R by plane rotations of neighbouring rows, bottom up; canonical form."""
    a = np.array(a, float)
    rows, n = a.shape
    for j in range(n):
        for i in range(rows - 1, j, -1):
            c, s = givens(a[i - 1, j], a[i, j])
            top = c * a[i - 1] + s * a[i]
            a[i] = c * a[i] - s * a[i - 1]
            a[i - 1] = top
    out = np.zeros((n, n))
    out[: min(rows, n)] = np.triu(a[:n])
    return positive_diagonal(out)


def cholesky_upper(gram: np.ndarray) -> np.ndarray:
    """R with R'R = gram. A Gram matrix that lacks rank, be it only up to rounding, raises LinAlgError."""
    scale = np.sqrt(np.diag(gram))
    if not (scale > 0).all():
        raise np.linalg.LinAlgError("a column is zero")
    low = np.linalg.cholesky(gram / np.outer(scale, scale))  # unit columns, so pivots tell how much of a column is new
    if (np.diag(low) ** 2).min() < 64 * len(gram) * np.finfo(float).eps:
        raise np.linalg.LinAlgError("the columns are dependent up to rounding")
    return low.T * scale


def gram_schmidt(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """QR by orthogonalising column after column (modified, so that it stays stable)."""
    q, n = np.array(a, float), a.shape[1]
    r = np.zeros((n, n))
    for j in range(n):
        r[j, j] = np.linalg.norm(q[:, j])
        if r[j, j]:
            q[:, j] /= r[j, j]
        r[j, j + 1 :] = q[:, j] @ q[:, j + 1 :]
        q[:, j + 1 :] -= np.outer(q[:, j], r[j, j + 1 :])
    return q, r


def canonical_vectors(v: np.ndarray) -> np.ndarray:
    """Columns signed so that their largest entry by size (the first of equals) is positive."""
    if not v.size:
        return v
    size = np.abs(v)
    at = np.argmax(size >= size.max(0) * (1 - 1e-9), axis=0)
    return v * np.where(v[at, np.arange(v.shape[1])] < 0, -1.0, 1.0)


def power_iteration(gram: np.ndarray, iterations: int = 10_000, tolerance: float = 1e-15, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of a Gram matrix one after the other, deflating; seeded, stops on convergence."""
    n, rest, rng = len(gram), np.array(gram, float), np.random.default_rng(seed)
    values, vectors = np.zeros(n), np.zeros((n, n))
    for k in range(n):
        v = rng.normal(size=n)
        for _ in range(iterations):
            w = rest @ v
            w -= vectors[:, :k] @ (vectors[:, :k].T @ w)
            size = np.linalg.norm(w)
            if size <= 1e-300:
                w, size = v - vectors[:, :k] @ (vectors[:, :k].T @ v), 1.0
                size = np.linalg.norm(w) or 1.0
            w /= size
            done = np.linalg.norm(w - v) < tolerance
            v = w
            if done:
                break
        vectors[:, k], values[k] = v, max(v @ rest @ v, 0.0)
        rest = rest - values[k] * np.outer(v, v)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def singular(r: np.ndarray, method: str = "divide_and_conquer", iterations: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
    """Singular values in falling order and canonical right vectors of the matrix whose upper factor is r."""
    if method in ("power_iter", "eigen"):
        values, v = power_iteration(r.T @ r, iterations) if method == "power_iter" else np.linalg.eigh(r.T @ r)
        order = np.argsort(-values, kind="stable")
        return np.sqrt(np.maximum(values[order], 0)), canonical_vectors(v[:, order])
    _, s, vt = np.linalg.svd(r)
    return s, canonical_vectors(vt.T)


def lu_partial(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """L (unit lower), U and the row order p with a[p] = L U; pivots are the largest by size, the first of equals."""
    u, n = np.array(a, float), a.shape[1]
    rows = np.arange(len(u))
    low = np.zeros((len(u), n))
    for j in range(min(n, len(u))):
        at = j + int(np.argmax(np.abs(u[j:, j])))
        for m in (u, low, rows):
            m[[j, at]] = m[[at, j]]
        low[j, j] = 1.0
        if u[j, j]:
            low[j + 1 :, j] = u[j + 1 :, j] / u[j, j]
            u[j + 1 :] -= np.outer(low[j + 1 :, j], u[j])
            u[j + 1 :, j] = 0.0
    return low, np.triu(u[:n]), rows


def lu_first_pivot(a: np.ndarray) -> np.ndarray:
    """U by elimination with the first non-zero pivot of each column."""
    u, n = np.array(a, float), a.shape[1]
    for j in range(min(n, len(u))):
        some = np.flatnonzero(u[j:, j])
        if len(some):
            at = j + int(some[0])
            u[[j, at]] = u[[at, j]]
            u[j + 1 :] -= np.outer(u[j + 1 :, j] / u[j, j], u[j])
    return np.triu(u[:n])


def inverse(a: np.ndarray) -> np.ndarray:
    return np.linalg.solve(a, np.eye(len(a)))


def pseudo_inverse(r: np.ndarray, tolerance: float = 1e-12) -> tuple[np.ndarray, int]:
    """The inverse on the directions whose singular value counts, and how many do."""
    u, s, vt = np.linalg.svd(r)
    good = s > tolerance * (s.max(initial=0) or 1.0)
    return (vt[good].T / s[good]) @ u[:, good].T, int(good.sum())


def solve_least_squares(r: np.ndarray) -> np.ndarray:
    """x of min |A x - b| from the upper factor of [A | b], also where A lacks rank."""
    n = len(r) - 1
    inv, rank = pseudo_inverse(r[:n, :n])
    return np.linalg.solve(r[:n, :n], r[:n, n]) if rank == n else inv @ r[:n, n]


def condition_number(r: np.ndarray) -> float:
    s = np.linalg.svd(r, compute_uv=False)
    return float(s[0] / s[-1]) if s[-1] else float("inf")


def scaled_condition(r: np.ndarray) -> float:
    """The condition number with unit columns, which is what a Cholesky factorisation squares."""
    size = np.linalg.norm(r, axis=0)
    return condition_number(r / size) if (size > 0).all() else float("inf")


def kept(percent: float, n: int) -> int:
    """Singular vectors that a percentage of n stands for."""
    return min(n, int(percent * n / 100))
