"""Projection, encoding, ordering, joins and reduction of relations."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tree import JoinTree, Node
from .gridjoin import grid_join, grids


def drop_attributes(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Project away; names that do not exist are ignored."""
    return df.drop(*names)


def reorder(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Only these attributes, in this order."""
    return df.select(*names)


def key_as_feature(df: DataFrame, keys: Sequence[str], suffix: str = "C") -> DataFrame:
    """Copies of join attributes, so that they also count as features."""
    return df.select("*", *[F.col(k).alias(f"{k}{suffix}") for k in keys])


def shrink_domain(df: DataFrame, column: str, domain: int) -> DataFrame:
    """Map a category's codes onto 0..domain-1 by a hash of the code; the same for every run and partitioning."""
    return df.withColumn(column, F.pmod(F.xxhash64(F.col(column).cast("bigint")), F.lit(domain)).cast("bigint"))


def category_codes(df: DataFrame, column: str, most: int = 10_000) -> list:
    """The distinct codes in rising order. A category has a bounded domain: beyond ``most`` codes it cannot be one-hot encoded."""
    codes = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(codes) > most:
        raise ValueError(f"{column} has more than {most} distinct codes; raise the limit or shrink its domain")
    return sorted(codes)


def one_hot(df: DataFrame, categories: Mapping[str, Sequence] | Sequence[str]) -> DataFrame:
    """Each category becomes a 0/1 column a code, in place, rising, without the first code; columns are named column + code."""
    domains = dict(categories) if isinstance(categories, Mapping) else {c: category_codes(df, c) for c in categories}
    out = []
    for c in df.columns:
        if c in domains:
            out += [F.when(F.col(c) == v, 1).otherwise(0).cast("bigint").alias(f"{c}{v}") for v in domains[c][1:]]
        else:
            out.append(F.col(c))
    return df.select(*out)


def sort_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.orderBy(*keys)


def shuffled(df: DataFrame, seed: int = 42) -> DataFrame:
    """Random order that repeats for equal rows and seed, whatever the partitioning: by a hash of the row."""
    return df.orderBy(F.xxhash64(F.lit(seed), *df.columns), *df.columns)


def alternate_features(features: Sequence[str], label: str) -> list[str]:
    """Every other feature, for regression on a part of the columns; the label is never among them."""
    return [f for f in features if f != label][::2]


#: Distinct values that the driver takes at a time to find the one where a share of the rows ends.
MOST_VALUES = 100_000


def top_fraction(df: DataFrame, fraction: float, order: Sequence[str] | None = None) -> DataFrame:
    """The floor(count * fraction) rows that come last by all columns, in no order.

    The row where they end is found column by column, from how often every value occurs among the rows that equal it so far.
    So no row is sorted or held anywhere: the rows beyond it are a filter, and rows equal to it, alike where the order names
    every column, are written out as often as wanted; df is not read again for them.
    Values are compared in structs, which order nulls and NaN as ORDER BY does and are never judged by a file's or a cached
    batch's least and largest value (those leave NaN out).
    """
    order, wanted, cells = list(order or df.columns), None, {}
    keep, equal, least = F.lit(False), F.lit(True), F.lit(True)
    for c in order:
        cell = F.struct(F.col(c).alias("v"))
        values = df.where(equal).groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n")).select(F.struct("v").alias("v"), "n").persist()
        try:
            if wanted is None:
                total = values.agg(F.sum("n")).first()[0] or 0
                wanted = math.floor(total * fraction)
                if wanted <= 0:
                    return df.limit(0)
                if wanted >= total:
                    return df
            last, wanted, there = _last_wanted(values, wanted)
        finally:
            values.unpersist()
        cells[c] = last.getField("v").alias(c)
        keep |= equal & (cell > last)
        equal &= cell == last
        if c == order[0]:
            least = cell >= last  # said apart, so that it reaches the relations below a join
        if wanted == there:
            return df.where(least & (keep | equal))
    alike = df.sparkSession.range(wanted).select(*[cells[c] for c in df.columns]) if cells.keys() >= set(df.columns) else df.where(equal).limit(wanted)
    return df.where(least & keep).unionAll(alike)


def _last_wanted(values: DataFrame, wanted: int) -> tuple[Column, int, int]:
    """The value of the wanted-th row in falling order, how many rows of it are wanted and how many there are.

    values: (v, n), v a struct of the value. While there are more of them than the driver takes, some, picked by hash, narrow
    the range to between two of them.
    """
    kind, falling, turn = values.schema["v"].dataType[0].dataType, F.col("v").desc(), 0
    literal = lambda v: F.struct(F.lit(v["v"]).cast(kind).alias("v"))
    while (size := values.count()) > MOST_VALUES:
        turn += 1
        picked = [literal(r["v"]) for r in values.where(F.pmod(F.xxhash64("v", F.lit(turn)), F.lit(-(-size // 40))) == 0).orderBy(falling).limit(60).collect()]
        ends = values.agg(*[F.coalesce(F.sum(F.when(F.col("v") >= s, F.col("n"))), F.lit(0)) for s in picked]).first() if picked else ()
        above = 0
        for split, n in zip(picked, ends):
            if n >= wanted:
                values = values.where(F.col("v") >= split)
                break
            above, values = n, values.where(F.col("v") < split)
        wanted -= above
    for v, n in values.orderBy(falling).collect():
        if wanted <= n:
            return literal(v), wanted, n
        wanted -= n
    raise ValueError("fewer rows than wanted")


def cartesian(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every pair of rows: what a natural join on a key with a single value is."""
    return left.crossJoin(right)


def natural_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that agree in all shared columns. Relations that share none have no join to push down: see cartesian."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("the relations share no attribute")
    return left.join(right, shared, "inner")


def materialise(tree: JoinTree) -> DataFrame:
    """The whole natural join: join attributes, then the features in tree order."""
    hot = grids(tree)

    def build(node: Node) -> DataFrame:
        out = node.df
        for child in node.children:
            out = grid_join(out, build(child), child.parent_keys, hot.get(child.name))
        return out

    keys = list(dict.fromkeys(k for n in tree.nodes for k in n.keys))
    return build(tree.root).select(*keys, *tree.features)


def reduce_fully(tree: JoinTree) -> JoinTree:
    """The tree without dangling rows: semi-joins up, then down; the join itself is never built."""
    frames = {n.name: n.df for n in tree.nodes}

    def up(node: Node) -> None:
        for child in node.children:
            up(child)
            frames[node.name] = frames[node.name].join(frames[child.name].select(*child.parent_keys).distinct(), child.parent_keys, "left_semi")

    def down(node: Node) -> None:
        for child in node.children:
            frames[child.name] = frames[child.name].join(frames[node.name].select(*child.parent_keys).distinct(), child.parent_keys, "left_semi")
            down(child)

    up(tree.root)
    down(tree.root)
    return tree.with_frames(frames)


def reduce_to(tree: JoinTree, rows: DataFrame) -> JoinTree:
    """Each relation's rows that take part in the given rows of the join."""
    frames = {}
    for n in tree.nodes:
        shared = [*n.keys, *n.features]
        frames[n.name] = n.df.join(rows.select(*shared).distinct(), shared, "left_semi")
    return tree.with_frames(frames)
