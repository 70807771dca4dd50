"""Upper factors and Gram matrices of distributed tall matrices, and of joins that are never built."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import linalg
from ..plans.tree import JoinTree, Node
from .counts import spread
from .headtail import Block

#: Up to this many features a Gram matrix is one row of sums; beyond, partitions add up matrices in numpy.
WIDE = 60


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1) if batch.num_columns else np.zeros((batch.num_rows, 0))


def _folded(rows: DataFrame, columns: Sequence[str], tag: int) -> DataFrame:
    """(block, r): each partition's rows folded batch by batch into one upper factor."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            if batch.num_rows:
                part = _matrix(batch)
                r = np.linalg.qr(part if r is None else np.concatenate([r, part]), mode="r")
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([tag], pa.int32()), pa.array([r.astype("<f8").tobytes()], pa.binary())], ["block", "r"])

    return rows.select(*[F.col(c).cast("double") for c in columns]).mapInArrow(fold, "block int, r binary")


def _merged(factors: DataFrame, widths: Sequence[int], fan_in: int) -> list[np.ndarray]:
    """The upper factor of every block, in one job: however many partitions the factors lie in, at most fan_in tasks merge
    theirs as they stream by, one factor of each block in memory, and the driver merges what those give."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            for tag, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(x, "<f8").reshape(-1, widths[tag])
                known[tag] = np.linalg.qr(np.concatenate([known[tag], part]), mode="r") if tag in known else part
        if known:
            yield pa.RecordBatch.from_arrays([pa.array(list(known), pa.int32()), pa.array([np.ascontiguousarray(r).tobytes() for r in known.values()], pa.binary())], ["block", "r"])

    tasks = min(fan_in, int(factors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    factors = factors.repartition(tasks).mapInArrow(merge, "block int, r binary")
    parts: list[list[np.ndarray]] = [[np.zeros((0, n))] for n in widths]
    for tag, r in factors.collect():  # at most fan_in factors a block
        parts[tag].append(np.frombuffer(bytes(r), "<f8").reshape(-1, widths[tag]))
    return [linalg.upper(np.concatenate(p)) for p in parts]


def tsqr(rows: DataFrame, columns: Sequence[str], fan_in: int = 32) -> np.ndarray:
    """The upper factor of a tall matrix: every partition folds its batches into an n x n factor, then the factors are folded.

    A task holds one batch and one factor at a time; the driver gets at most fan_in factors.
    """
    return _merged(_folded(rows, columns, 0), [len(columns)], fan_in)[0]


def upper_of_blocks(found: Sequence[Block], features: Sequence[str], fan_in: int = 32) -> np.ndarray:
    """R of the reduced matrix in one job: each block in its own width, then the small factors together."""
    folded = None
    for tag, b in enumerate(found):
        part = _folded(b.rows, b.columns, tag)
        folded = part if folded is None else folded.unionAll(part)
    if folded is None:
        return np.zeros((len(features), len(features)))
    stack = []
    for b, small in zip(found, _merged(folded, [len(b.columns) for b in found], fan_in)):
        r = np.zeros((len(b.columns), len(features)))
        r[:, [features.index(c) for c in b.columns]] = small
        stack.append(r)
    return linalg.upper(np.concatenate(stack))


def gram_row(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with sum(x * y) for every pair of columns, named g_i_j with i <= j from 1."""
    return rows.agg(*[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0.0)).alias(f"g_{i + 1}_{j + 1}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j])


def gram(rows: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """A'A of a tall matrix, by JVM aggregates up to WIDE columns and by partition sums beyond."""
    n = len(columns)
    if n <= WIDE:
        return from_row(gram_row(rows, columns).first(), n)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for batch in batches:
            a = _matrix(batch)
            total += a.T @ a
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(n), n)), pa.array(np.tile(np.arange(n), n)), pa.array(total.reshape(-1))], ["i", "j", "v"])

    cells = rows.select(*[F.col(c).cast("double") for c in columns]).mapInArrow(local, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((n, n))
    for r in cells:
        out[r["i"], r["j"]] = r["v"]
    return out


def from_row(row, n: int) -> np.ndarray:
    out = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            out[i, j] = out[j, i] = row[f"g_{i + 1}_{j + 1}"]
    return out


#: Columns up to which Spark generates code for an aggregate (spark.sql.codegen.maxFields).
GENERATED_FIELDS = 100


def fits_generated_code(n: int) -> bool:
    """Whether count, sums and products of n features stay below that many columns."""
    return 1 + n + n * (n + 1) // 2 <= GENERATED_FIELDS


def cofactors(tree: JoinTree) -> DataFrame:
    """A'A of the natural join as one row g_i_j, by counts, sums and sums of products pushed through the tree.

    Each relation is grouped by its parent keys before it meets its parent, so no join ever has more rows than the
    relation above it; hot keys are summed on the map side first and split by the join. With few features everything stays
    in generated JVM code (see fits_generated_code); with more, upper_factor's orthogonal way carries fewer columns.
    """

    def up(node: Node) -> tuple[DataFrame, list[str]]:
        f = list(node.features)
        rows = node.df.select(*node.keys, F.lit(1.0).alias("__c"), *[F.col(x).alias(f"s|{x}") for x in f], *[(F.col(x) * F.col(y)).alias(f"q|{x}|{y}") for i, x in enumerate(f) for y in f[i:]])
        for child in node.children:
            below, g = up(child)
            rows = _product(rows, f, spread(below), g, child.parent_keys, node.keys)
            f += g
        keys = [] if node.is_root else node.parent_keys
        sums = [F.sum(F.col(f"`{c}`")).alias(c) for c in rows.columns if c not in node.keys]
        return (rows.groupBy(*keys).agg(*sums) if keys else rows.agg(*sums)), f

    total, order = up(tree.root)
    place = {x: i for i, x in enumerate(order)}
    name = lambda x, y: f"`q|{x}|{y}`" if place[x] <= place[y] else f"`q|{y}|{x}`"
    wanted = tree.features
    return total.select(*[F.coalesce(F.col(name(x, y)), F.lit(0.0)).alias(f"g_{i + 1}_{j + 1}") for i, x in enumerate(wanted) for j, y in enumerate(wanted) if i <= j])


def _product(rows: DataFrame, f: list[str], below: DataFrame, g: list[str], on: list[str], keys: list[str]) -> DataFrame:
    """The ring product: counts multiply, sums scale by the other count, products of features of both sides are sum * sum."""
    below = below.select(*on, *[F.col(f"`{c}`").alias(f"{c}>") for c in below.columns if c not in on])
    joined = rows.join(below, on)
    c1, c2 = F.col("__c"), F.col("`__c>`")
    cells = [(c1 * c2).alias("__c")]
    cells += [(F.col(f"`s|{x}`") * c2).alias(f"s|{x}") for x in f] + [(F.col(f"`s|{y}>`") * c1).alias(f"s|{y}") for y in g]
    cells += [(F.col(f"`q|{x}|{y}`") * c2).alias(f"q|{x}|{y}") for i, x in enumerate(f) for y in f[i:]]
    cells += [(F.col(f"`q|{x}|{y}>`") * c1).alias(f"q|{x}|{y}") for i, x in enumerate(g) for y in g[i:]]
    cells += [(F.col(f"`s|{x}`") * F.col(f"`s|{y}>`")).alias(f"q|{x}|{y}") for x in f for y in g]
    return joined.select(*keys, *cells)


def factorised_gram(tree: JoinTree) -> np.ndarray:
    return from_row(cofactors(tree).first(), len(tree.features))
