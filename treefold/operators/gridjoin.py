"""Joins with far more rows than their relations, dealt out by the rows they make.

A hash join gives each key to one task, and adaptive execution merges and splits tasks by the bytes they read. Where a
few keys meet with thousands of rows on both sides, the input is small and the output is not: a handful of tasks makes all
of it. Here the rows of such a key are dealt onto a grid, rows of the left side over its lines and rows of the right side over its
columns, and every cell is joined by itself. A side is copied once for each line or column of the other, which is two rows read
for CELL rows made at most. Keys that make up to CELL * CELL rows stay whole.

Equal rows of a side go through the exchange and the join as one row and a number, RUN of them at most, and what they make is written
out behind the join, row after row. Such runs take next to no room in columnar files, where rows in mixed order take a lot.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tree import JoinTree, Node
from .counts import down_counts, multiplicity

#: Rows of either side in a cell.
CELL = 1000
#: Rows that a task makes, about.
TASK_ROWS = 4_000_000
#: Equal rows that are dealt together. Small beside CELL, so that cells stay about alike.
RUN = 64
#: Up to this many hot keys are broadcast.
MOST_BROADCAST = 100_000


@dataclass(frozen=True)
class Grid:
    """cells: (keys, __a, __b), lines and columns of each hot key; tasks: over how many the join is dealt."""

    cells: DataFrame
    tasks: int


def grids(tree: JoinTree) -> dict[str, Grid]:
    """Of each relation whose join with its parent, and with the children before it, has hot keys; none for most trees.

    One job takes the longest key group of every relation; their product bounds what a key can make, and only where that is
    large the rows of every key are counted, without joining.
    """
    if not tree.root.children:
        return {}
    longest = _longest_groups(tree)
    found, down = {}, None
    for node in tree.nodes:
        above = 1.0
        for at, child in enumerate(node.children):
            below = math.prod(longest[n.name, tuple(n.parent_keys)] for n in child.walk())
            if longest[node.name, tuple(child.parent_keys)] * above * below > CELL * CELL:
                down = down or down_counts(tree, exact=False)
                if grid := _grid(node, at, down):
                    found[child.name] = grid
            above *= below
    return found


def _longest_groups(tree: JoinTree) -> dict[tuple[str, tuple], int]:
    """The most rows that a key has, by relation and key attributes (its parent keys and those of its children)."""
    wanted = [(n, tuple(keys)) for n in tree.nodes for keys in dict.fromkeys([*([] if n.is_root else [tuple(n.parent_keys)]), *(tuple(c.parent_keys) for c in n.children)])]
    counted = [n.df.groupBy(*keys).agg(F.count("*").alias("v")).agg(F.lit(i).alias("i"), F.max("v").alias("v")) for i, (n, keys) in enumerate(wanted)]
    most = {r["i"]: r["v"] or 0 for r in reduce(DataFrame.unionAll, counted).collect()}
    return {(n.name, keys): most[i] for i, (n, keys) in enumerate(wanted)}


def _grid(node: Node, at: int, down: dict[str, DataFrame]) -> Grid | None:
    """The grid of the join of node and its first children with the next child, or None without hot keys."""
    below = lambda c: down[c.name].groupBy(*c.parent_keys).agg(F.sum("down").alias("__r"))
    rows = multiplicity(node).withColumn("__l", F.col("v").cast("double")).drop("v")
    for c in node.children[:at]:
        rows = rows.join(below(c), c.parent_keys).withColumn("__l", F.col("__l") * F.col("__r")).drop("__r")
    child = node.children[at]
    both = rows.groupBy(*child.parent_keys).agg(F.sum("__l").alias("__l")).join(below(child), child.parent_keys)
    made = F.col("__l") * F.col("__r")
    hot = made > float(CELL * CELL)
    total = both.agg(F.sum(made).alias("rows"), F.count_if(hot).alias("hot")).first()
    if not total["hot"]:
        return None
    cells = both.where(hot).select(*child.parent_keys, F.ceil(F.col("__l") / CELL).alias("__a"), F.ceil(F.col("__r") / CELL).alias("__b"))
    tasks = max(int(node.df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total["rows"] / TASK_ROWS))
    return Grid(F.broadcast(cells) if total["hot"] <= MOST_BROADCAST else cells, tasks)


def grid_join(left: DataFrame, right: DataFrame, keys: list[str], grid: Grid | None) -> DataFrame:
    """The inner join on keys, which both sides name alike."""
    if grid is None:
        return left.join(right, keys)

    def dealt(df: DataFrame, mine: str, other: str, place: str, over: str, number: str) -> DataFrame:
        marked = _runs(df).join(grid.cells, keys, "left")
        spot = F.coalesce(F.pmod(F.xxhash64(*df.columns, "__k"), F.col(mine)), F.lit(0).cast("bigint"))
        copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col(other), F.lit(1)) - 1))
        return marked.select(*df.columns, F.col("__n").alias(number), spot.alias(place), copies.alias(over)).repartition(grid.tasks, *keys, "__i", "__j")

    both = dealt(left, "__a", "__b", "__i", "__j", "__l").join(dealt(right, "__b", "__a", "__j", "__i", "__r"), [*keys, "__i", "__j"]).drop("__i", "__j")
    rows = [c for c in both.columns if c not in ("__l", "__r")]
    return both.select(*rows, F.explode(F.expr("sequence(1, __l * __r)")).alias("__n")).select(*rows)


def _runs(df: DataFrame, stretch: int = 4096) -> DataFrame:
    """The rows of df, up to RUN equal ones as one row: how many in __n, and a number in __k. Row and number fix the cell, so a task
    that runs again deals as before."""
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("__m"))
    begun = counted.select("*", F.explode(F.expr(f"sequence(0L, (__m - 1) div {stretch * RUN})")).alias("__s"))  # no array of all numbers
    runs = begun.select(*df.columns, "__m", F.explode(F.expr(f"sequence(__s * {stretch}, least((__m - 1) div {RUN}, (__s + 1) * {stretch} - 1))")).alias("__k"))
    return runs.select(*df.columns, "__k", F.expr(f"cast(least({RUN}, __m - __k * {RUN}) as int)").alias("__n"))
