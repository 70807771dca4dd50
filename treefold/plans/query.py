"""JSON queries: a tree of relations under one operator, dispatched by the operator's name."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators import decompose, relational
from ..operators.decompose import Factors
from ..sources.relation import Database
from .tree import JoinTree, Shape, attributes_of, best_root

#: Suffixes of operators over one materialised relation, and the methods they stand for (fixed values).
METHODS = {
    "QR": {"HOUSEHOLDER": "", "GIV_THIN_DIAG": "", "SPARSE": ""},
    "LU": {"LAPACK": "", "THIN": ""},
    "SVD": {
        "DIV_AND_CONQ": "divide_and_conquer", "QR_ITER": "qr_iter", "QR": "qr_iter", "POWER_ITER": "power_iter",
        "EIGEN_DECOMP": "eigen", "EIGEN_DECOMP_DIV_AND_CONQ": "eigen", "EIGEN_DECOMP_QR_ITER": "eigen", "EIGEN_DECOMP_RRR": "eigen",
    },
}
METHODS["PCA"] = METHODS["SVD"]
#: The suffix of factorised operators; a caller may name others that stand for it.
FACTORISED = "TREE"


def operator(name: str, aliases: Sequence[str] = ()) -> tuple[str, str]:
    """Kind and method of an operator name.

    QR_x, LU_x, SVD_x and PCA_x with an x from METHODS name an algorithm; with x = TREE or one of ``aliases``, the
    factorised operator. LIN_REG solves normal equations; LIN_REG_x (x as before) and LLS_QR solve least squares by QR.
    """
    factorised = (FACTORISED, *aliases)
    if name == "eval_join":
        return "join", ""
    if name == "LIN_REG":
        return "lin_reg", ""
    if name == "LLS_QR" or name.startswith("LIN_REG_") and name[8:] in factorised:
        return "lls", ""
    kind, _, suffix = name.partition("_")
    if kind in METHODS and suffix in METHODS[kind]:
        return kind.lower(), METHODS[kind][suffix]
    if kind in METHODS and suffix in factorised:
        return kind.lower(), "divide_and_conquer" if kind in ("SVD", "PCA") else ""
    known = ", ".join(f"{k}_{x}" for k, m in METHODS.items() for x in (*m, *factorised))
    raise ValueError(f"unknown operator {name!r}; known are eval_join, LIN_REG, LLS_QR, {known}; name other suffixes of factorised operators as aliases")


@dataclass
class Options:
    """What a call may override: inner algorithm, share of singular vectors, iterations, whether rows are wanted, and
    suffixes of operator names that stand for the factorised operator."""

    method: str | None = None
    percent: float = 100.0
    iterations: int = 10_000
    compute_all: bool | None = None
    factor: str = "auto"
    categories: dict[str, list[str]] = field(default_factory=dict)
    aliases: tuple[str, ...] = ()


def shape_of(node: Mapping) -> Shape:
    """The tree of a natural_join or relation node."""
    if node["operator"] == "relation":
        return node["relation"]
    if node["operator"] != "natural_join":
        raise ValueError(f"{node['operator']} cannot stand in a join tree")
    central = shape_of(node["central_relation"])
    return (central, *(shape_of(c) for c in node.get("children", [])))


def _orders(node: Mapping) -> dict[str, list[str]]:
    if node["operator"] == "relation":
        return {node["relation"]: node["attributes_order"]} if node.get("attributes_order") else {}
    out = _orders(node["central_relation"])
    for c in node.get("children", []):
        out |= _orders(c)
    return out


def tree_of(db: Database, hint: Mapping, options: Options | None = None) -> JoinTree:
    """The join tree under an operator, with attributes skipped and categories one-hot encoded."""
    operand = hint["operands"][0]
    shape, orders = shape_of(operand), _orders(operand)
    frames = {}
    names = attributes_of(shape)
    skip = hint.get("skip_attributes", [])
    columns = {n: orders.get(n, db.relations[n].columns) for n in names}
    shared = {a for n in names for a in columns[n] if sum(a in columns[m] for m in names) > 1}
    for n in names:
        df = db.relations[n].select(*[c for c in columns[n] if c not in skip])
        known = (options.categories.get(n) if options else None) or (db.schemas[n].categories if n in db.schemas else [])
        frames[n] = relational.one_hot(df, [c for c in known if c in df.columns and c not in shared])
    order = hint.get("relation_order")
    if order and list(order) != names:
        raise ValueError(f"relation_order {order} is not the preorder {names} of the join tree")
    if hint.get("root") == "best":  # the columns come in the new tree's preorder
        shape = best_root(shape, frames)
    return JoinTree(shape, frames)


def run_query(db: Database, query: str | Mapping, options: Options | None = None) -> Factors | DataFrame:
    """Run one JSON query (text, path or dict). Joins and assignments give DataFrames, decompositions give Factors."""
    if isinstance(query, str):
        query = json.loads(query) if query.lstrip().startswith("{") else json.loads(open(query, encoding="utf-8").read())
    return _run(db, query["query"]["evaluation_hint"], options or Options())


def _run(db: Database, hint: Mapping, options: Options) -> Factors | DataFrame:
    name = hint["operator"]
    if name == "assign":
        operand = hint["operands"][0]
        leaf = operand["operator"] in ("natural_join", "relation")
        inner = {"operator": "eval_join", "operands": [operand]} if leaf else operand
        found = _run(db, inner, options)
        rows = found.rows if isinstance(found, Factors) else found
        if rows is None:
            raise ValueError(f"{inner['operator']} has no rows to assign; set compute_all")
        db.add(hint["name"], rows.persist())
        rows.createOrReplaceTempView(hint["name"])
        return rows
    if name in ("natural_join", "relation"):
        return _run(db, {"operator": "eval_join", "operands": [hint]}, options)
    kind, method = operator(name, options.aliases)
    tree = tree_of(db, hint, options)
    if kind == "join":
        return relational.materialise(tree)
    every = hint.get("compute_all", False) if options.compute_all is None else options.compute_all
    method = options.method or method
    if kind == "qr":
        return decompose.qr(tree, every, options.factor)
    if kind == "lu":
        return decompose.lu(tree, every)
    if kind == "svd":
        return decompose.svd(tree, every, options.percent, method, options.iterations, options.factor)
    if kind == "pca":
        return decompose.pca(tree, options.percent, method, options.iterations, options.factor)
    label = hint["label_name"]
    return (decompose.linear_regression if kind == "lin_reg" else decompose.least_squares)(tree, label, options.factor)
