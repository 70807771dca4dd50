"""Kernels against literal values and invariants."""

import numpy as np
import pytest

from treefold.functions import linalg as la

M = np.array([[1.0, 2], [3, 4], [4, 3]])
R = np.array([[5.099019513592785, 5.099019513592786], [0, 1.732050807568877]])
S = np.array([[1.0, 2, 27], [3, 4, 12], [5, 6, 13], [7, 8, 14], [9, 23, 17]])


def test_upper_factors_agree():
    assert np.allclose(la.upper(M), R, atol=1e-13)
    assert np.allclose(la.givens_upper(M), R, atol=1e-13)
    assert np.allclose(la.cholesky_upper(M.T @ M), R, atol=1e-13)
    q, r = la.householder_qr(M)
    assert np.allclose(r, R) and np.allclose(q @ r, M)
    q, r = la.gram_schmidt(M)
    assert np.allclose(la.positive_diagonal(r), R) and np.allclose(q.T @ q, np.eye(2))


def test_upper_pads_short_matrices():
    assert la.upper(np.array([[3.0, 4, 0]])).tolist() == [[3, 4, 0], [0, 0, 0], [0, 0, 0]]
    assert la.upper(np.zeros((0, 2))).tolist() == [[0, 0], [0, 0]]


@pytest.mark.parametrize("method", ["divide_and_conquer", "qr_iter", "power_iter", "eigen"])
def test_singular_values(method):
    s, v = la.singular(la.upper(S), method)
    assert np.allclose(s, [44.989193549900570, 17.417873990872451, 3.686479264511551], atol=1e-9)
    scores = np.abs(S @ v[:, :2])
    assert np.allclose(scores[0], [23.978239547619253, 12.532232599498553], atol=1e-7)
    assert np.allclose(scores[4], [27.519438032252665, 11.808100102604470], atol=1e-7)


def test_lu():
    low, u, p = la.lu_partial(np.array([[1.0, 2], [3, 4], [5, 6]]))
    assert p.tolist() == [2, 0, 1]
    assert np.allclose(low, [[1, 0], [0.2, 1], [0.6, 0.5]]) and np.allclose(u, [[5, 6], [0, 0.8]])
    assert np.allclose(la.lu_first_pivot(np.array([[0.0, 2], [3, 4], [5, 6]])), [[3, 4], [0, 2]])


def test_inverse_and_condition():
    assert np.allclose(la.inverse(np.array([[1.0, 2, 3], [0, 4, 5], [0, 0, 7]])), [[1, -0.5, -0.071428571428571], [0, 0.25, -0.178571428571429], [0, 0, 0.142857142857143]])
    assert np.allclose(la.inverse(np.array([[1.0, 2, 3], [4, 5, 6], [10, 11, 13]])), [[1 / 3, -7 / 3, 1], [-8 / 3, 17 / 3, -2], [2, -3, 1]])
    assert np.isclose(la.condition_number(la.upper(np.array([[1.0, 7, 2], [27, 13, 4], [22, 21, 6], [13, 25, 21]]))), 10.189359555015979)


def test_least_squares():
    a = np.array([[1.0, 2, 3, 4], [2, 5, 6, 7], [3, 6, 9, 10], [4, 7, 10, 11]])
    b = np.array([30.0, 58, 82, 92])
    assert np.allclose(la.solve_least_squares(la.upper(np.column_stack([a, b]))), [1, 2, 3, 4])


def test_rank_deficient():
    inv, rank = la.pseudo_inverse(np.array([[1.0, 1], [0, 0]]))
    assert rank == 1 and np.allclose(inv, [[0.5, 0], [0.5, 0]])


def test_givens_rotation():
    c, s = la.givens(3.0, 4.0)
    assert np.allclose([c * 3 + s * 4, c * 4 - s * 3], [5, 0]) and la.givens(0.0, 0.0) == (1.0, 0.0)
    a = np.array([[3.0, 4], [4, 3]])
    assert np.allclose([c * a[0] + s * a[1], c * a[1] - s * a[0]], [[5, 4.8], [0, -1.4]])
