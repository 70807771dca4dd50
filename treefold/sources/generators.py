"""Synthetic relations: uniform with key domains, cartesian pairs, and pairs whose leading factor is known exactly."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform_relation(spark: SparkSession, rows: int, columns: int, keys: dict[str, int], seed: int = 1, prefix: str = "A", low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Integer keys drawn from domains 1..size and uniform features."""
    picks = [(F.floor(F.rand(seed * 1009 + i) * size) + 1).cast("bigint").alias(k) for i, (k, size) in enumerate(keys.items())]
    values = [(F.rand(seed * 2003 + i) * (high - low) + low).alias(f"{prefix}{i + 1}") for i in range(columns)]
    return spark.range(rows).select(*picks, *values)


def keyed_product(spark: SparkSession, keys: dict[str, int]) -> DataFrame:
    """Every combination of the key domains once: a composite primary key."""
    first, *rest = [spark.range(1, size + 1).withColumnRenamed("id", k) for k, size in keys.items()]
    for other in rest:
        first = first.crossJoin(other)
    return first


def cartesian_pair(spark: SparkSession, rows: tuple[int, int], columns: tuple[int, int], seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Two relations that share one key value, so that their natural join is the cartesian product."""
    return (
        uniform_relation(spark, rows[0], columns[0], {"A": 1}, seed, "R"),
        uniform_relation(spark, rows[1], columns[1], {"A": 1}, seed + 1, "S"),
    )


def counting_factor(n: int) -> np.ndarray:
    """The upper triangle 1, 2, 3, ... row by row."""
    r = np.zeros((n, n))
    r[np.triu_indices(n)] = np.arange(1, n * (n + 1) // 2 + 1)
    return r


def known_factor_pair(spark: SparkSession, rows: tuple[int, int], n: int, seed: int = 1) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """X = Q * counting_factor(n) and a Y to pair it with; the leading block of the product's R is sqrt(|Y|) * counting_factor(n).

    For tests: both are made in the driver's memory.
    """
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.normal(size=(rows[0], n)))
    x, y = q @ counting_factor(n), rng.normal(size=(rows[1], n))
    frame = lambda m, p: spark.createDataFrame([(1, *map(float, r)) for r in m], ["A", *(f"{p}{i + 1}" for i in range(n))])
    return frame(x, "X"), frame(y, "Y"), np.sqrt(rows[1]) * counting_factor(n)
