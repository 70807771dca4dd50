"""Count aggregates pushed through the join tree: multiplicities, down, up and circle counts, the join's size.

Every table has one row for each distinct key; nothing is joined row by row. Dangling rows need
not be removed first: a key without partners below drops out of the down counts, one without partners above out of the
up counts. The final table of each relation, which several others need, is persisted into ``kept`` where the caller gives
such a list; down counts are cheaper to take from reused exchanges.

Counts are exact longs; a join of more than 2**63 - 1 rows raises an overflow. With exact=False they are doubles, right to 16
digits and without that limit, which is what the roots of counts in heads and tails need.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tree import JoinTree, Node


@dataclass
class NodeCounts:
    """Of one relation: by join key (v, down, circle), and by parent key (down, up)."""

    by_key: DataFrame
    by_parent: DataFrame


def keep(df: DataFrame, kept: list[DataFrame] | None) -> DataFrame:
    """df, persisted and noted in kept if there is one; release() gives all of it up."""
    if kept is not None:
        df = df.persist()
        kept.append(df)
    return df


def release(kept: list[DataFrame]) -> None:
    while kept:
        kept.pop().unpersist()


def spread(df: DataFrame) -> DataFrame:
    """An aggregate, dealt out once more, so that the join above it stands on two plain exchanges.

    Adaptive execution splits the hot partitions of such a join only; directly on an aggregate it cannot.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def multiplicity(node: Node) -> DataFrame:
    """Distinct join keys and how many rows have each."""
    return node.df.groupBy(*node.keys).agg(F.count("*").alias("v"))


def _down(node: Node, out: dict[str, DataFrame], exact: bool) -> DataFrame:
    by_key = multiplicity(node)
    by_key = (by_key if exact else by_key.withColumn("v", F.col("v").cast("double"))).withColumn("down", F.col("v"))
    for child in node.children:
        below = _down(child, out, exact).withColumnRenamed("pdown", "__d")
        by_key = by_key.join(below, child.parent_keys).withColumn("down", F.col("down") * F.col("__d")).drop("__d")
    out[node.name] = by_key
    return by_key.groupBy(*node.parent_keys).agg(F.sum("down").alias("pdown"))


def down_counts(tree: JoinTree, exact: bool = True) -> dict[str, DataFrame]:
    """Per relation (keys, v, down): rows of the subtree's join for each key."""
    out: dict[str, DataFrame] = {}
    _down(tree.root, out, exact)
    return out


def parent_down_counts(tree: JoinTree, name: str) -> DataFrame:
    """(parent keys, pdown) of one relation."""
    node = next(n for n in tree.nodes if n.name == name)
    return down_counts(tree)[name].groupBy(*node.parent_keys).agg(F.sum("down").alias("pdown"))


def all_counts(tree: JoinTree, kept: list[DataFrame] | None = None, exact: bool = True) -> dict[str, NodeCounts]:
    """Down, up and circle counts of every relation, for the keys that take part in the join.

    circle(k) is how often each row with key k occurs in the join, up(p) how often each row of the subtree's join does.
    """
    downs, out = down_counts(tree, exact), {}
    # Both divisions leave no remainder; on longs they stay exact beyond 2**53.
    ratio = (lambda a, b: F.expr(f"{a} div {b}")) if exact else (lambda a, b: F.col(a) / F.col(b))

    def visit(node: Node, up: DataFrame | None) -> None:
        by_key = downs[node.name]
        by_key = by_key.withColumn("full", F.col("down")) if up is None else by_key.join(up, node.parent_keys).withColumn("full", F.col("down") * F.col("up")).drop("up")
        by_key = keep(by_key.withColumn("circle", ratio("full", "v")), kept)
        by_parent = by_key.groupBy(*node.parent_keys).agg(F.sum("down").alias("pdown"))
        by_parent = by_parent.withColumn("up", F.lit(1).cast("bigint" if exact else "double")) if up is None else by_parent.join(up, node.parent_keys)
        out[node.name] = NodeCounts(by_key.select(*node.keys, "v", "down", "circle"), by_parent)
        for child in node.children:
            below = downs[child.name].groupBy(*child.parent_keys).agg(F.sum("down").alias("__d"))
            total = by_key.groupBy(*child.parent_keys).agg(F.sum("full").alias("__f"))
            visit(child, total.join(below, child.parent_keys).select(*child.parent_keys, ratio("__f", "__d").alias("up")))

    visit(tree.root, None)
    return out


def join_size(tree: JoinTree) -> DataFrame:
    """The row count of the natural join, without joining: one row (join_rows)."""
    return down_counts(tree)[tree.root.name].agg(F.coalesce(F.sum("down"), F.lit(0)).alias("join_rows"))
