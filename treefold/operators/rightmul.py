"""A times a small matrix over the join tree: partial products per relation, joined and added up along the tree."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tree import JoinTree, Node
from .gridjoin import grid_join, grids


def combination(features: list[str], weights: np.ndarray) -> Column:
    """Sum of weight * feature, without the zero terms."""
    out = None
    for f, w in zip(features, weights.tolist()):
        if w:
            term = F.col(f) * F.lit(float(w))
            out = term if out is None else out + term
    return F.lit(0.0) if out is None else out


def right_multiply(tree: JoinTree, m: np.ndarray, prefix: str = "c", keep_features: bool = False) -> DataFrame:
    """Rows of the join as (join attributes, prefix1.. prefixk): A @ m, with only k columns a relation in every join."""
    k, place, hot = m.shape[1], {f: i for i, f in enumerate(tree.features)}, grids(tree)

    def build(node: Node) -> DataFrame:
        own = m[[place[f] for f in node.features]] if node.features else np.zeros((0, k))
        cells = [combination(node.features, own[:, j]).alias(f"__{node.name}_{j}") for j in range(k)]
        out = node.df.select(*node.keys, *(node.features if keep_features else []), *cells)
        for child in node.children:
            out = grid_join(out, build(child), child.parent_keys, hot.get(child.name))
            mine = [c for c in out.columns if not (c.startswith(f"__{node.name}_") or c.startswith(f"__{child.name}_"))]
            out = out.select(*mine, *[(F.col(f"__{node.name}_{j}") + F.col(f"__{child.name}_{j}")).alias(f"__{node.name}_{j}") for j in range(k)])
        return out

    keys = list(dict.fromkeys(a for n in tree.nodes for a in n.keys))
    return build(tree.root).select(*keys, *(tree.features if keep_features else []), *[F.col(f"__{tree.root.name}_{j}").alias(f"{prefix}{j + 1}") for j in range(k)])


def extreme_row(tree: JoinTree, z: np.ndarray) -> tuple[np.ndarray, dict] | None:
    """The join row a whose |a . z| is largest and its join attributes, found by (max, +) aggregates pushed through the tree.

    Both signs go through the tree together: one job. Ties go to the larger value of a . z, then to the larger row, by
    features first. No join row is built except the answer.
    """
    place = {f: i for i, f in enumerate(tree.features)}
    if not tree.root.children:
        return _extreme_of_rows(tree.root, z)
    signs = ("__hi", "__lo")

    def up(node: Node) -> tuple[DataFrame, list[str], list[str]]:
        score = combination(node.features, z[[place[f] for f in node.features]]) if node.features else F.lit(0.0)
        rows, names, keys = node.df.select(*node.keys, *node.features, score.alias("__score")), list(node.features), list(node.keys)
        best = {"__hi": F.col("__score"), "__lo": -F.col("__score")}
        cells = {s: {c: F.col(c) for c in [*names, *keys]} for s in signs}
        for child in node.children:
            below, more, more_keys = up(child)
            rows = rows.join(below.select(*child.parent_keys, *[F.col(s).alias(f"{s}_{child.name}") for s in signs]), child.parent_keys)
            names += more
            fresh = [k for k in more_keys if k not in keys]
            keys += fresh
            for s in signs:
                of = F.col(f"{s}_{child.name}")
                best[s] = best[s] + of.getField("__score")
                cells[s] |= {c: of.getField(c) for c in [*more, *fresh]}
        found = rows.select(*node.keys, *[F.struct(best[s].alias("__score"), *[cells[s][c].alias(c) for c in [*names, *keys]]).alias(s) for s in signs])
        most = [F.max(s).alias(s) for s in signs]
        return (found.agg(*most) if node.is_root else found.groupBy(*node.parent_keys).agg(*most)), names, keys

    total, _, keys = up(tree.root)
    row = total.first()
    if row is None or row["__hi"] is None:
        return None
    best = row["__hi"] if row["__hi"]["__score"] >= row["__lo"]["__score"] else row["__lo"]
    return np.array([best[f] for f in tree.features], float), {k: best[k] for k in keys}


def _extreme_of_rows(node: Node, z: np.ndarray) -> tuple[np.ndarray, dict] | None:
    """The same of a single relation: the extremes as plain numbers, in generated code, then the largest of the rows that reach it."""
    score, cells = combination(node.features, z), [*node.features, *node.keys]
    lo, hi = node.df.agg(F.min(score), F.max(score)).first()
    if hi is None:
        return None
    best = hi if hi >= -lo else lo
    row = node.df.where(score == best).agg(F.max(F.struct(*cells)).alias("row")).first()["row"]
    return np.array([row[f] for f in node.features], float), {k: row[k] for k in node.keys}
