"""QR, LU, SVD, PCA and least squares over joins (factorised) or over one materialised relation.

A factorised operator never builds the join unless Q, U, L or scores are asked for, which have a row for each join row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import linalg
from ..plans.tree import JoinTree
from .counts import all_counts, release
from .factor import factorised_gram, fits_generated_code, gram, tsqr, upper_of_blocks
from .headtail import blocks
from .matrix import multiply
from .rightmul import extreme_row, right_multiply


@dataclass
class Factors:
    """What a decomposition gives; unset parts were not asked for. ``rows`` has a row for each row of A."""

    features: list[str]
    r: np.ndarray | None = None
    u: np.ndarray | None = None
    sigma: np.ndarray | None = None
    v: np.ndarray | None = None
    pivots: np.ndarray | None = None
    pivot_columns: list[int] = field(default_factory=list)
    pivot_keys: list[dict] = field(default_factory=list)
    coefficients: dict[str, float] = field(default_factory=dict)
    rank: int | None = None
    rows: DataFrame | None = None


#: Beyond this condition number (of unit columns) "auto" takes the orthogonal way.
MOST_CONDITION = 1e4


def single(df: DataFrame, name: str = "A", keys: Sequence[str] = (), features: Sequence[str] | None = None) -> JoinTree:
    """One materialised relation as a tree without joins."""
    return JoinTree(name, {name: df.select(*(features or [c for c in df.columns if c not in keys]))})


def upper_factor(tree: JoinTree, method: str = "auto") -> np.ndarray:
    """R of the join. heads_tails: orthogonal throughout; cofactor: Gram and Cholesky, faster, squares the condition number;
    auto: cofactor while its sums stay in generated code, and heads_tails beyond that or where the condition number says
    that cofactor has lost more than half of its digits. Cofactor without full rank is heads_tails as well."""
    if method == "auto":
        if not fits_generated_code(len(tree.features)):
            return upper_factor(tree, "heads_tails")
        r = _cofactor_upper(tree)
        return r if r is not None and linalg.scaled_condition(r) < MOST_CONDITION else upper_factor(tree, "heads_tails")
    if method == "cofactor":
        r = _cofactor_upper(tree)
        return r if r is not None else upper_factor(tree, "heads_tails")
    if not tree.root.children:
        return tsqr(tree.root.df, tree.features)
    kept: list[DataFrame] = []  # counts serve several blocks; they are computed once
    try:
        return upper_of_blocks(blocks(tree, all_counts(tree, kept, exact=False), True), tree.features)
    finally:
        release(kept)


def _cofactor_upper(tree: JoinTree) -> np.ndarray | None:
    """R from the Gram matrix; None without full rank. Its inner joins drop dangling rows by themselves."""
    try:
        return linalg.cholesky_upper(factorised_gram(tree) if tree.root.children else gram(tree.root.df, tree.features))
    except np.linalg.LinAlgError:
        return None


def qr(tree: JoinTree, compute_q: bool = False, method: str = "auto") -> Factors:
    """R with a non-negative diagonal and, on demand, the rows of Q = A R^-1 (q1..qn) over the join.

    method cholesky_qr2 factors Q'Q once more and corrects Q and R by it, which makes Q orthogonal to working precision.
    """
    r = upper_factor(tree, "cofactor" if method == "cholesky_qr2" else method)
    out = Factors(tree.features, r=r)
    inv, out.rank = linalg.pseudo_inverse(r)
    full = out.rank == len(r)
    if compute_q or method == "cholesky_qr2":
        out.rows = right_multiply(tree, linalg.inverse(r) if full else inv, "q")
    if method == "cholesky_qr2" and full:
        names = [f"q{i + 1}" for i in range(len(r))]
        again = linalg.cholesky_upper(gram(out.rows, names))
        out.r = again @ r
        keys = [c for c in out.rows.columns if c not in names]
        out.rows = multiply(out.rows.select(*keys, *names), linalg.inverse(again), keys, prefix="q")
    return out


def svd(tree: JoinTree, compute_u: bool = False, percent: float = 100.0, method: str = "divide_and_conquer", iterations: int = 10_000, factor: str = "auto") -> Factors:
    """Singular values, right vectors and, on demand, the first percent of left vectors (u1..uk) over the join.

    method: divide_and_conquer or qr_iter (SVD of R), power_iter or eigen (of the Gram matrix).
    """
    r = upper_factor(tree, "cofactor" if method in ("power_iter", "eigen") else factor)
    sigma, v = linalg.singular(r, method, iterations)
    out = Factors(tree.features, r=r, sigma=sigma, v=v)
    if compute_u:
        k = linalg.kept(percent, len(sigma))
        safe = np.where(sigma[:k] > 1e-12 * (sigma[0] or 1.0), sigma[:k], np.inf)
        out.rows = right_multiply(tree, v[:, :k] / safe, "u")
    return out


def pca(tree: JoinTree, percent: float = 100.0, method: str = "divide_and_conquer", iterations: int = 10_000, factor: str = "auto") -> Factors:
    """Scores (p1..pk) of the first percent of components: U * sigma, without centring."""
    out = svd(tree, False, percent, method, iterations, factor)
    k = linalg.kept(percent, len(out.sigma))
    out.rows = right_multiply(tree, out.v[:, :k], "p")
    return out


def _with_label(tree: JoinTree, label: str) -> tuple[list[str], int]:
    found = [f for f in tree.features if f == label or f.split("__", 1)[1] == label]
    if len(found) != 1:
        raise ValueError(f"label {label}: {len(found)} features have that name")
    return [f for f in tree.features if f != found[0]], tree.features.index(found[0])


def linear_regression(tree: JoinTree, label: str, factor: str = "auto") -> Factors:
    """Coefficients without intercept of label on all other features, from R'R by normal equations."""
    names, at = _with_label(tree, label)
    r = upper_factor(tree, factor)
    g = r.T @ r
    rest = [i for i in range(len(g)) if i != at]
    x = np.linalg.lstsq(g[np.ix_(rest, rest)], g[rest, at], rcond=None)[0]
    return Factors(names, r=r, coefficients=dict(zip(names, x.tolist())))


def least_squares(tree: JoinTree, label: str, factor: str = "auto") -> Factors:
    """The same coefficients by R x = Q'b: the label's column of R goes last and is solved against."""
    names, at = _with_label(tree, label)
    r = upper_factor(tree, factor)
    order = [i for i in range(len(r)) if i != at] + [at]
    x = linalg.solve_least_squares(linalg.upper(r[:, order]))
    return Factors(names, r=r, coefficients=dict(zip(names, x.tolist())))


def lu(tree: JoinTree, compute_l: bool = False) -> Factors:
    """LU with partial pivoting of the join: U, the pivot rows with their join attributes and, on demand, the rows of L
    (l1..ln), with A = L U.

    Step j needs the join row with the largest residual in column j. The residual is a linear function of the row, so
    its extremes are (max, +) aggregates over the tree: exact pivoting, one pass a column, and no join. A column that
    depends on those before it has a zero pivot: its row of U and its column of L are zero, and no row is its pivot.
    """
    n = len(tree.features)
    u, rows, keys, done = np.zeros((n, n)), [], [], []
    for j in range(n):
        z = np.zeros(n)
        z[j] = 1.0
        if done:
            z[done] = -np.linalg.solve(u[np.ix_(done, done)], u[done, j])
        found = extreme_row(tree, z)
        if found is None:
            raise ValueError("the join is empty")
        row, key = found
        rest = row - (np.linalg.solve(u[np.ix_(done, done)].T, row[done]) @ u[done] if done else 0)
        rest[: j + 1] = [0.0] * j + [rest[j]]
        if abs(rest[j]) <= 1e-12 * max(1.0, np.abs(row).max()):
            continue
        u[j] = rest
        done.append(j)
        rows.append(row)
        keys.append(key)
    out = Factors(tree.features, u=u, pivots=np.array(rows).reshape(-1, n), pivot_columns=done, pivot_keys=keys, rank=len(done))
    if compute_l:
        m = np.zeros((n, n))
        m[np.ix_(done, done)] = linalg.inverse(u[np.ix_(done, done)])
        out.rows = right_multiply(tree, m, "l")
    return out
