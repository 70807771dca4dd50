"""Relations as matrices: row-wise arithmetic, products with small matrices, norms and checks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import linalg
from .factor import gram
from .rightmul import combination


def _values(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in keys]


def add(left: DataFrame, right: DataFrame, keys: Sequence[str], sign: int = 1) -> DataFrame:
    """Values of rows with equal keys, added column by column; columns are matched by place and named as on the left."""
    names = _values(left, keys)
    other = right.select(*keys, *[F.col(c).alias(f"__{i}") for i, c in enumerate(_values(right, keys))])
    return left.join(other, list(keys)).select(*keys, *[(F.col(c) + F.col(f"__{i}") * sign).alias(c) for i, c in enumerate(names)])


def subtract(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return add(left, right, keys, -1)


def beside(left: DataFrame, right: DataFrame, keys: Sequence[str], pad: float = 0.0) -> DataFrame:
    """Horizontal concatenation of matrices whose rows are named by keys; a row that one of them lacks is padded there."""
    a, b = _values(left, keys), _values(right, keys)
    if clash := set(a) & set(b):
        raise ValueError(f"both sides have columns {sorted(clash)}")
    return left.join(right, list(keys), "full_outer").select(*keys, *[F.coalesce(F.col(c), F.lit(float(pad))).alias(c) for c in [*a, *b]])


def below(upper: DataFrame, lower: DataFrame, pad: float = 0.0) -> DataFrame:
    """Vertical concatenation by column name; a column that one of them lacks is padded there."""
    names = [*upper.columns, *(c for c in lower.columns if c not in upper.columns)]
    rows = lambda df: df.select(*[F.col(c) if c in df.columns else F.lit(float(pad)).alias(c) for c in names])
    return rows(upper).unionAll(rows(lower))


def multiply(df: DataFrame, m: np.ndarray, keys: Sequence[str] = (), start: int = 0, prefix: str = "c") -> DataFrame:
    """Values times the rows of m from ``start`` on; keys stay."""
    names = _values(df, keys)
    part = np.asarray(m, float)[start : start + len(names)]
    return df.select(*keys, *[combination(names, part[:, j]).alias(f"{prefix}{j + 1}") for j in range(part.shape[1])])


def multiply_diagonal(df: DataFrame, diagonal: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    return df.select(*keys, *[(F.col(c) * F.lit(float(d))).alias(c) for c, d in zip(_values(df, keys), diagonal)])


def multiply_transpose(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """left' right over rows with equal keys, as one row p_i_j."""
    a, b = _values(left, keys), _values(right, keys)
    other = right.select(*keys, *[F.col(c).alias(f"__{j}") for j, c in enumerate(b)])
    return left.join(other, list(keys)).agg(*[F.coalesce(F.sum(F.col(x) * F.col(f"__{j}")), F.lit(0.0)).alias(f"p_{i + 1}_{j + 1}") for i, x in enumerate(a) for j in range(len(b))])


def frobenius(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row (norm)."""
    total = F.lit(0.0)
    for c in _values(df, keys):
        total = total + F.col(c) * F.col(c)
    return df.agg(F.sqrt(F.coalesce(F.sum(total), F.lit(0.0))).alias("norm"))


def orthogonality(q: DataFrame, columns: Sequence[str]) -> float:
    """|I - Q'Q| / |I|."""
    n = len(columns)
    return float(np.linalg.norm(np.eye(n) - gram(q, columns)) / np.sqrt(n))


def residual(a: DataFrame, features: Sequence[str], q: Sequence[str], r: np.ndarray) -> float:
    """|Q R - A| / |A| of rows that hold both A's and Q's columns."""
    off = [(combination(list(q), r[:, j]) - F.col(f)) for j, f in enumerate(features)]
    square = lambda cells: sum((c * c for c in cells[1:]), cells[0] * cells[0])
    got = a.agg(F.sqrt(F.sum(square(off))).alias("e"), F.sqrt(F.sum(square([F.col(f) for f in features]))).alias("n")).first()
    return float(got["e"] / got["n"]) if got["n"] else 0.0


def compare_factors(first: np.ndarray, second: np.ndarray, digits: int = 12) -> tuple[float, bool]:
    """Relative Frobenius difference of two upper factors in canonical form, and whether it is below 10**-digits."""
    a, b = linalg.positive_diagonal(first), linalg.positive_diagonal(second)
    error = float(np.linalg.norm(a - b) / (np.linalg.norm(b) or 1.0))
    return error, error < 10.0**-digits


def as_rows(spark, m: np.ndarray) -> DataFrame:
    """A small matrix as (i, j, value), from 1."""
    return spark.createDataFrame([(i + 1, j + 1, float(v)) for i, r in enumerate(np.atleast_2d(m)) for j, v in enumerate(r)], "i int, j int, value double")
