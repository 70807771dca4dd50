"""Heads and tails: an orthogonal change of basis inside each key group, pushed through the join tree.

For a group of rows y_1..y_v with weights w_j the head is the weighted mean direction and the tails are what Householder-
like rotations leave orthogonal to it; both are running sums. Heads travel up the tree (one row a key), tails stay behind
as finished rows of the reduced matrix M, for which M'M = A'A with A the materialised join.

Rows are ordered by all feature columns inside a group: ties are equal rows, so the set of tails is deterministic.

Where only M'M counts, as for R, tails need no order: a group's rows less their mean (weighted: less their share of the
head) are the same tails turned by an orthogonal matrix. ``blocks(centred=True)`` makes them so, by a join with the heads in
place of a window: no group is ever gathered or sorted, heads are summed on the map side, and adaptive execution splits
the join at a hot key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.tree import JoinTree, Node
from .counts import NodeCounts, all_counts, spread

SCALE = "__scale"


@dataclass
class Block:
    """Rows of the reduced matrix that are zero outside ``columns``."""

    name: str
    columns: list[str]
    rows: DataFrame


def heads(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(keys, features, scale): the sum of each group over the root of its size, and that root."""
    root = F.sqrt(F.count("*"))
    return df.groupBy(*keys).agg(*[(F.sum(f) / root).alias(f) for f in features], root.alias(SCALE))


def tails(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(keys, features) of rows 2..v of each group: (y_i (i-1) - sum before) / sqrt(i (i-1))."""
    order = Window.partitionBy(*keys).orderBy(*features)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    i = F.row_number().over(order)
    ranked = df.select(*keys, *features, i.alias("__i"), *[F.sum(f).over(before).alias(f"__s_{f}") for f in features])
    norm = F.sqrt(F.col("__i") * (F.col("__i") - 1))
    cells = [F.when(F.col("__i") > 1, (F.col(f) * (F.col("__i") - 1) - F.col(f"__s_{f}")) / norm).alias(f) for f in features]
    return ranked.where("__i > 1").select(*keys, *cells)


def weighted_heads(df: DataFrame, keys: Sequence[str], features: Sequence[str], scale: str = SCALE) -> DataFrame:
    """(keys, features, scale): sum of scale * row over the root of the summed squares of scale, and that root."""
    root = F.sqrt(F.sum(F.col(scale) * F.col(scale)))
    return df.groupBy(*keys).agg(*[(F.sum(F.col(scale) * F.col(f)) / root).alias(f) for f in features], root.alias(SCALE))


def weighted_tails(df: DataFrame, keys: Sequence[str], features: Sequence[str], scale: str = SCALE) -> DataFrame:
    """(keys, features) of rows 2.. of each group: (A_i s_before - v_i sum v_j A_j) / sqrt(s_upto s_before), s the running sum of v²."""
    order = Window.partitionBy(*keys).orderBy(scale, *features)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    v = F.col(scale)
    ranked = df.select(
        *keys, *features, v.alias("__v"), F.row_number().over(order).alias("__i"), F.sum(v * v).over(before).alias("__b"),
        *[F.sum(v * F.col(f)).over(before).alias(f"__s_{f}") for f in features],
    )
    norm = F.sqrt((F.col("__b") + F.col("__v") * F.col("__v")) * F.col("__b"))
    cells = [F.when(F.col("__i") > 1, (F.col(f) * F.col("__b") - F.col("__v") * F.col(f"__s_{f}")) / norm).alias(f) for f in features]
    return ranked.where("__i > 1").select(*keys, *cells)


def _times(rows: DataFrame, keys: Sequence[str], weights: DataFrame, column: str, features: Sequence[str]) -> DataFrame:
    """rows' features times the root of a count that is joined on by key."""
    root = F.sqrt(F.col(column))
    return rows.join(spread(weights.select(*keys, column)), list(keys)).select(*keys, *[(F.col(f) * root).alias(f) for f in features])


def centred(rows: DataFrame, heads_of: DataFrame, keys: Sequence[str], weights: DataFrame, column: str, features: Sequence[str], scale: Column | None = None) -> DataFrame:
    """rows less their share of their group's head, times the root of a count: (row - scale * head / head's scale) * root.

    Orthogonally equivalent to tails (scale None: all rows weigh one) and weighted tails; inner joins drop dangling rows.
    """
    stats = heads_of.join(weights.select(*keys, column), list(keys)).select(
        *keys, F.sqrt(F.col(column)).alias("__root"), *[(F.col(f) / F.col(SCALE)).alias(f"__m_{f}") for f in features]
    )
    part = (lambda f: F.col(f"__m_{f}")) if scale is None else (lambda f: scale * F.col(f"__m_{f}"))
    return rows.join(spread(stats), list(keys)).select(*keys, *[((F.col(f) - part(f)) * F.col("__root")).alias(f) for f in features])


def aggregate_away(own: DataFrame, node: Node, below: dict[str, DataFrame]) -> DataFrame:
    """Join the children's heads to a node's heads; each block is scaled by the product of all other scales."""
    joined = own.withColumnRenamed(SCALE, "__own")
    for c in node.children:
        joined = joined.join(below[c.name].withColumnRenamed(SCALE, f"__of_{c.name}"), c.parent_keys)
    scales = {"": F.col("__own"), **{c.name: F.col(f"__of_{c.name}") for c in node.children}}

    def but(name: str) -> Column:
        out = F.lit(1.0)
        for other, s in scales.items():
            out = out if other == name else out * s
        return out

    cells = [(F.col(f) * but("")).alias(f) for f in node.features]
    for c in node.children:
        cells += [(F.col(f) * but(c.name)).alias(f) for f in c.subtree_features()]
    return joined.select(*node.keys, *cells, but("-").alias(SCALE))


def blocks(tree: JoinTree, counts: dict[str, NodeCounts] | None = None, centred_tails: bool = False) -> list[Block]:
    """The reduced matrix of a tree, block by block: tails, generalised tails, and the root's heads.

    Dangling rows drop out at the joins with the counts: all rows of a key share their fate.
    """
    counts, out = counts or all_counts(tree), []

    def visit(node: Node) -> DataFrame:
        below = {c.name: visit(c) for c in node.children}
        c, keys, own_features = counts[node.name], node.keys, node.features
        if own_features:
            own = heads(node.df, keys, own_features)
            if centred_tails:
                rows = centred(node.df, own, keys, c.by_key, "circle", own_features)
            else:
                rows = _times(tails(node.df, keys, own_features), keys, c.by_key, "circle", own_features)
            out.append(Block(f"tail_{node.name}", own_features, rows))
        else:
            own = node.df.groupBy(*keys).agg(F.sqrt(F.count("*")).alias(SCALE))
        features = node.subtree_features()
        joined = aggregate_away(own, node, below) if node.children else own
        if set(node.parent_keys) == set(keys) and not node.is_root:
            return joined  # one row a key already
        if node.is_root:
            if features:
                out.append(Block(f"head_{node.name}", features, joined.select(*node.parent_keys, *features)))
            return joined
        keys = node.parent_keys
        up = weighted_heads(joined, keys, features)
        if features:
            if centred_tails:
                rows = centred(joined, up, keys, c.by_parent, "up", features, F.col(SCALE))
            else:
                rows = _times(weighted_tails(joined, keys, features), keys, c.by_parent, "up", features)
            out.append(Block(f"gen_tail_{node.name}", features, rows))
        return up

    visit(tree.root)
    return out


def generalised(tree: JoinTree, name: str) -> tuple[DataFrame, DataFrame]:
    """Generalised heads (parent keys, features, scale) and weighted generalised tails of one relation's subtree."""
    counts = all_counts(tree)

    def joined(node: Node) -> DataFrame:
        own = heads(node.df, node.keys, node.features)
        return aggregate_away(own, node, {c.name: up(c) for c in node.children}) if node.children else own

    def up(node: Node) -> DataFrame:
        return weighted_heads(joined(node), node.parent_keys, node.subtree_features())

    node = next(n for n in tree.nodes if n.name == name)
    rows, features = joined(node), node.subtree_features()
    late = weighted_tails(rows, node.parent_keys, features)
    return weighted_heads(rows, node.parent_keys, features), _times(late, node.parent_keys, counts[name].by_parent, "up", features)


def block_union(found: Sequence[Block], features: Sequence[str]) -> DataFrame:
    """The reduced matrix as one relation, zero outside each block's columns."""
    out = None
    for b in found:
        rows = b.rows.select(*[F.col(f) if f in b.columns else F.lit(0.0).alias(f) for f in features])
        out = rows if out is None else out.unionByName(rows)
    return out


def pivot_heads(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """The row of each group whose first feature is largest by size; ties to the least row."""
    order = Window.partitionBy(*keys).orderBy(F.abs(F.col(features[0])).desc(), *features)
    return df.select(*keys, *features, F.row_number().over(order).alias("__i")).where("__i = 1").select(*keys, *features)


def pivot_tails(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Every other row of each group less its pivot row."""
    order = Window.partitionBy(*keys).orderBy(F.abs(F.col(features[0])).desc(), *features)
    ranked = df.select(*keys, *features, F.row_number().over(order).alias("__i"), *[F.first(f).over(order).alias(f"__h_{f}") for f in features])
    return ranked.where("__i > 1").select(*keys, *[(F.col(f) - F.col(f"__h_{f}")).alias(f) for f in features])
