"""The query catalogue over the test tables, and DuckDB SQL for every entry that SQL can express.

Trees: T1 orders(customer, lineitem), T2 nation(customer, supplier), T3 lineitem(orders(customer), part, supplier),
T4 region(nation(customer(orders), supplier)). Features are scaled to order one, so that rounded values compare.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import counts, decompose, factor, headtail, matrix, relational
from .plans import tree as plans_tree
from .plans.query import Options, run_query
from .plans.tree import JoinTree
from .functions import linalg
from .functions.timing import Timers
from .sources import generators
from .sources.scratch import scratch
from .sources.relation import Database, random_relation, write_csv

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Per relation: (column, name in the tree, factor); keys have factor None. The SQL views below are made from the same list.
FIELDS = {
    "orders": [("o_orderkey", "orderkey", None), ("o_custkey", "custkey", None), ("o_totalprice", "o_totalprice", 1e5)],
    "customer": [("c_custkey", "custkey", None), ("c_nationkey", "nationkey", None), ("c_acctbal", "c_acctbal", 1e4)],
    "lineitem": [("l_orderkey", "orderkey", None), ("l_partkey", "partkey", None), ("l_suppkey", "suppkey", None), ("l_quantity", "l_quantity", 1e1), ("l_extendedprice", "l_extendedprice", 1e5), ("l_discount", "l_discount", 1e-1)],
    "nation": [("n_nationkey", "nationkey", None), ("n_regionkey", "regionkey", None)],
    "supplier": [("s_suppkey", "suppkey", None), ("s_nationkey", "nationkey", None), ("s_acctbal", "s_acctbal", 1e4)],
    "part": [("p_partkey", "partkey", None), ("p_retailprice", "p_retailprice", 1e3), ("p_size", "p_size", 1e1)],
    "region": [("r_regionkey", "regionkey", None)],
}
TREES = {
    "t1": (("orders", "customer", "lineitem"), {"orders": ["orderkey", "custkey", "o_totalprice"], "customer": ["custkey", "c_acctbal"], "lineitem": ["orderkey", "l_quantity", "l_extendedprice", "l_discount"]}),
    "t2": (("nation", "customer", "supplier"), {"nation": ["nationkey"], "customer": ["nationkey", "c_acctbal"], "supplier": ["nationkey", "s_acctbal"]}),
    "t3": (("lineitem", ("orders", "customer"), "part", "supplier"), {"lineitem": ["orderkey", "partkey", "suppkey", "l_quantity", "l_extendedprice"], "orders": ["orderkey", "custkey", "o_totalprice"], "customer": ["custkey", "c_acctbal"], "part": ["partkey", "p_retailprice"], "supplier": ["suppkey", "s_acctbal"]}),
    "t4": (("region", ("nation", ("customer", "orders"), "supplier")), {"region": ["regionkey"], "nation": ["nationkey", "regionkey"], "customer": ["custkey", "nationkey", "c_acctbal"], "orders": ["custkey", "o_totalprice"], "supplier": ["nationkey", "s_acctbal"]}),
}


def tree(spark: SparkSession, sf_dir: str, name: str) -> JoinTree:
    shape, columns = TREES[name]
    frames = {}
    for r, names in columns.items():
        by = {to: (c, f) for c, to, f in FIELDS[r]}
        frames[r] = table(spark, sf_dir, r).select(*[(F.col(by[n][0]).cast("bigint") if by[n][1] is None else F.col(by[n][0]).cast("double") / by[n][1]).alias(n) for n in names])
    return JoinTree(shape, frames)


def reduced(spark: SparkSession, sf_dir: str, name: str) -> JoinTree:
    return relational.reduce_fully(tree(spark, sf_dir, name))


def _view(r: str, names: Sequence[str]) -> str:
    by = {to: (c, f) for c, to, f in FIELDS[r]}
    cells = ", ".join(f"CAST({by[n][0]} AS BIGINT) AS {n}" if by[n][1] is None else f"CAST({by[n][0]} AS DOUBLE) / {by[n][1]!r} AS {n}" for n in names)
    return f"v_{r} AS (SELECT {cells} FROM {r})"


def ctes(name: str) -> str:
    """WITH views of a tree's relations and j, their natural join (features by their own names)."""
    _, columns = TREES[name]
    return "WITH " + ", ".join([*(_view(r, names) for r, names in columns.items()), "j AS (SELECT * FROM " + " NATURAL JOIN ".join(f"v_{r}" for r in columns) + ")"])


# Row-wise results are compared at nine digits, those of Q and U at eight.


def rounded(df: DataFrame, names: Sequence[str], digits: int = 9, rename: Callable[[str], str] = lambda c: c.split("__", 1)[-1]) -> DataFrame:
    """Doubles rounded, without negative zeros, features by their own names."""
    return df.select(*[(_round(F.col(c).cast("double"), digits) + 0.0).alias(rename(c)) if t in ("double", "float") else F.col(c).alias(rename(c)) for c, t in df.select(*names).dtypes])


def _round(x: Column, digits: int) -> Column:
    """Half away from zero by arithmetic on doubles, as DuckDB's round; Spark's makes a decimal from the text of every value."""
    y = x * float(10**digits)
    whole = F.when(F.abs(y - F.rint(y)) == 0.5, y + F.signum(y) * 0.5).otherwise(F.rint(y))  # rint takes ties to even
    return F.when(F.abs(x) < 1e290, whole / float(10**digits)).otherwise(x)


def r9(x: str, name: str, digits: int = 9) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name}"


def cells_row(spark: SparkSession, m: np.ndarray, prefix: str, upper: bool = True, digits: int = 9) -> DataFrame:
    """A small matrix as one row prefix11, prefix12, ..."""
    m = np.atleast_2d(m)
    cells = [(f"{prefix}{i + 1}{j + 1}", round(float(v), digits) + 0.0) for i, r in enumerate(m) for j, v in enumerate(r) if not upper or i <= j]
    return spark.createDataFrame([tuple(v for _, v in cells)], ", ".join(f"{c} double" for c, _ in cells))


def vector_row(spark: SparkSession, v: Sequence[float], prefix: str, digits: int = 6) -> DataFrame:
    return spark.createDataFrame([tuple(round(float(x), digits) + 0.0 for x in v)], ", ".join(f"{prefix}{i + 1} double" for i in range(len(v))))


# --- joins, reduction, ordering, projection -------------------------------------------------------------------------

T1 = ["o_totalprice", "c_acctbal", "l_quantity", "l_extendedprice", "l_discount"]


@query(ctes("t1") + " SELECT orderkey, custkey, " + ", ".join(r9(c, c) for c in T1) + " FROM j")
def join_materialize(spark, sf_dir):
    t = tree(spark, sf_dir, "t1")
    return rounded(df := relational.materialise(t), df.columns)


@query(ctes("t3") + " SELECT count(*) AS join_rows FROM j")
def join_assign_count(spark, sf_dir):
    db = Database(spark)
    shape, columns = TREES["t3"]
    for r, names in columns.items():
        by = {to: c for c, to, _ in FIELDS[r]}
        db.add(r, table(spark, sf_dir, r).select(*[F.col(by[n]).alias(n) for n in names]))
    leaf = lambda n: {"operator": "relation", "relation": n}
    node = lambda s: leaf(s) if isinstance(s, str) else {"operator": "natural_join", "central_relation": leaf(s[0]), "children": [node(c) for c in s[1:]]}
    rows = run_query(db, {"query": {"evaluation_hint": {"operator": "assign", "name": "joined", "operands": [node(shape)]}}})
    return rows.agg(F.count("*").alias("join_rows"))


def _semi(name: str, r: str, on: str) -> str:
    return ctes(name) + f" SELECT {', '.join(c if f is None else r9(c, c) for _, c, f in FIELDS[r] if c in TREES[name][1][r])} FROM v_{r} WHERE {on} IN (SELECT {on} FROM j)"


@query(_semi("t1", "orders", "orderkey"))
def full_reducer_orders(spark, sf_dir):
    n = reduced(spark, sf_dir, "t1").root
    return rounded(n.df, [*n.keys, *n.features])


@query(_semi("t2", "customer", "nationkey"))
def full_reducer_customer(spark, sf_dir):
    n = reduced(spark, sf_dir, "t2").nodes[1]
    return rounded(n.df, [*n.keys, *n.features])


@query(ctes("t2") + ", d AS (SELECT nationkey, c_acctbal, s_acctbal FROM j) SELECT nationkey, " + r9("c_acctbal", "c_acctbal") + ", " + r9("s_acctbal", "s_acctbal") + " FROM (SELECT * FROM d ORDER BY nationkey DESC, c_acctbal DESC, s_acctbal DESC LIMIT (SELECT CAST(floor(count(*) * 0.05) AS BIGINT) FROM d))")
def top_fraction_join(spark, sf_dir):
    rows = relational.materialise(tree(spark, sf_dir, "t2"))
    return rounded(top := relational.top_fraction(rows, 0.05), top.columns)


@query("SELECT r_regionkey, n_nationkey FROM region CROSS JOIN nation")
def cartesian_pair(spark, sf_dir):
    return relational.cartesian(table(spark, sf_dir, "region").select("r_regionkey"), table(spark, sf_dir, "nation").select("n_nationkey"))


@query("SELECT l_orderkey, l_quantity, l_discount FROM lineitem")
def drop_attrs(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_tax")
    return relational.drop_attributes(df, ["l_partkey", "l_tax", "not_there"])


@query("SELECT l_discount, l_orderkey FROM lineitem")
def reorder_attrs(spark, sf_dir):
    return relational.reorder(table(spark, sf_dir, "lineitem"), ["l_discount", "l_orderkey"])


@query("WITH c AS (SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS s FROM customer) SELECT c_custkey, CAST(s = 1 AS BIGINT) AS s1, CAST(s = 2 AS BIGINT) AS s2, CAST(s = 3 AS BIGINT) AS s3, CAST(s = 4 AS BIGINT) AS s4 FROM c")
def one_hot_drop_first(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    names = relational.category_codes(df, "c_mktsegment")
    code = F.coalesce(*[F.when(F.col("c_mktsegment") == v, F.lit(i)) for i, v in enumerate(names)])
    return relational.one_hot(df.select("c_custkey", code.alias("s")), ["s"])


@query("SELECT l_orderkey, l_suppkey, l_orderkey AS l_orderkeyC FROM lineitem")
def key_as_feature(spark, sf_dir):
    return relational.key_as_feature(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), ["l_orderkey"])


@query("SELECT l_orderkey, l_quantity FROM lineitem")
def sort_relation(spark, sf_dir):
    return relational.sort_by(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity"), ["l_orderkey", "l_quantity"])


# --- counts ---------------------------------------------------------------------------------------------------------


@query("SELECT CAST(l_orderkey AS BIGINT) AS orderkey, count(*) AS v FROM lineitem GROUP BY l_orderkey")
def key_multiplicity(spark, sf_dir):
    return counts.multiplicity(tree(spark, sf_dir, "t1").nodes[2]).select("orderkey", "v")


_SUB = "sub AS (SELECT v_customer.nationkey, v_customer.custkey FROM v_customer NATURAL JOIN v_orders)"


@query(ctes("t4") + f", {_SUB} SELECT custkey, nationkey, count(*) AS down FROM sub GROUP BY ALL")
def down_counts(spark, sf_dir):
    return counts.down_counts(tree(spark, sf_dir, "t4"))["customer"].select("custkey", "nationkey", "down")


@query(ctes("t4") + f", {_SUB} SELECT nationkey, count(*) AS pdown FROM sub GROUP BY nationkey")
def parent_down_counts(spark, sf_dir):
    return counts.parent_down_counts(tree(spark, sf_dir, "t4"), "customer").select("nationkey", "pdown")


@query(ctes("t4") + f", {_SUB}, d AS (SELECT nationkey, count(*) AS d FROM sub GROUP BY nationkey), f AS (SELECT nationkey, count(*) AS f FROM j GROUP BY nationkey) SELECT nationkey, CAST(f / d AS BIGINT) AS up FROM d JOIN f USING (nationkey)")
def up_counts(spark, sf_dir):
    return counts.all_counts(tree(spark, sf_dir, "t4"))["customer"].by_parent.select("nationkey", "up")


@query(ctes("t4") + ", v AS (SELECT nationkey, count(*) AS v FROM v_supplier GROUP BY nationkey), f AS (SELECT nationkey, count(*) AS f FROM j GROUP BY nationkey) SELECT nationkey, CAST(f / v AS BIGINT) AS circle FROM v JOIN f USING (nationkey)")
def circle_counts(spark, sf_dir):
    return counts.all_counts(tree(spark, sf_dir, "t4"))["supplier"].by_key.select("nationkey", "circle")


@query(ctes("t4") + " SELECT count(*) AS join_rows FROM j")
def join_size(spark, sf_dir):
    return counts.join_size(tree(spark, sf_dir, "t4"))


# --- heads and tails ------------------------------------------------------------------------------------------------

_L = ["l_quantity", "l_extendedprice", "l_discount"]
_LT = ctes("t1") + ", w AS (SELECT orderkey, " + ", ".join(_L) + ", row_number() OVER o AS i, " + ", ".join(f"sum({c}) OVER (PARTITION BY orderkey ORDER BY {', '.join(_L)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s_{c}" for c in _L) + f" FROM v_lineitem WINDOW o AS (PARTITION BY orderkey ORDER BY {', '.join(_L)}))"


@query(ctes("t1") + " SELECT orderkey, " + ", ".join(r9(f"sum({c}) / sqrt(count(*))", c) for c in _L) + ", " + r9("sqrt(count(*))", "scale") + " FROM v_lineitem GROUP BY orderkey")
def qr_heads(spark, sf_dir):
    n = tree(spark, sf_dir, "t1").nodes[2]
    return rounded(h := headtail.heads(n.df, n.keys, n.features).withColumnRenamed(headtail.SCALE, "scale"), h.columns)


@query(_LT + " SELECT orderkey, " + ", ".join(r9(f"({c} * (i - 1) - s_{c}) / sqrt(i * (i - 1))", c) for c in _L) + " FROM w WHERE i > 1")
def qr_tails(spark, sf_dir):
    n = tree(spark, sf_dir, "t1").nodes[2]
    return rounded(t := headtail.tails(n.df, n.keys, n.features), t.columns)


_T4H = ctes("t4") + """, ho AS (SELECT custkey, sum(o_totalprice) / sqrt(count(*)) AS h, sqrt(count(*)) AS s FROM v_orders GROUP BY custkey),
a AS (SELECT c.nationkey, c.custkey, c.c_acctbal * ho.s AS x, ho.h AS y, ho.s AS v FROM v_customer c JOIN ho USING (custkey))"""


@query(_T4H + " SELECT custkey, nationkey, " + ", ".join(r9(a, b) for a, b in (("x", "c_acctbal"), ("y", "o_totalprice"), ("v", "scale"))) + " FROM a")
def agg_away(spark, sf_dir):
    t = tree(spark, sf_dir, "t4")
    c, o = t.nodes[2], t.nodes[3]
    own = headtail.heads(c.df, c.keys, c.features)
    return rounded(a := headtail.aggregate_away(own, c, {"orders": headtail.heads(o.df, o.keys, o.features)}).withColumnRenamed(headtail.SCALE, "scale"), a.columns)


@query(_T4H + " SELECT nationkey, " + ", ".join(r9(f"sum(v * {a}) / sqrt(sum(v * v))", b, 5) for a, b in (("x", "c_acctbal"), ("y", "o_totalprice"))) + ", " + r9("sqrt(sum(v * v))", "scale", 5) + " FROM a WHERE nationkey IN (SELECT nationkey FROM j) GROUP BY nationkey")
def gen_heads(spark, sf_dir):
    h, _ = headtail.generalised(tree(spark, sf_dir, "t4"), "customer")
    return rounded(h := h.withColumnRenamed(headtail.SCALE, "scale"), h.columns, 5)


@query(
    _T4H
    + """, w AS (SELECT *, row_number() OVER o AS i, sum(v * v) OVER p AS b, sum(v * x) OVER p AS sx, sum(v * y) OVER p AS sy FROM a
WINDOW o AS (PARTITION BY nationkey ORDER BY v, x, y), p AS (PARTITION BY nationkey ORDER BY v, x, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sub AS (SELECT nationkey, count(*) AS d FROM v_customer NATURAL JOIN v_orders GROUP BY nationkey), full_ AS (SELECT nationkey, count(*) AS f FROM j GROUP BY nationkey),
u AS (SELECT nationkey, f / d AS up FROM sub JOIN full_ USING (nationkey))
SELECT nationkey, """
    + ", ".join(r9(f"({a} * b - v * s{a}) / sqrt((b + v * v) * b) * sqrt(up)", n, 5) for a, n in (("x", "c_acctbal"), ("y", "o_totalprice")))
    + " FROM w JOIN u USING (nationkey) WHERE i > 1"
)
def gen_tails(spark, sf_dir):
    _, t = headtail.generalised(tree(spark, sf_dir, "t4"), "customer")
    return rounded(t, t.columns, 5)


@query(_LT.replace(", w AS", ", w0 AS") + f", h AS (SELECT *, row_number() OVER (PARTITION BY orderkey ORDER BY abs(l_quantity) DESC, {', '.join(_L)}) AS k FROM v_lineitem) SELECT orderkey, " + ", ".join(r9(c, c) for c in _L) + " FROM h WHERE k = 1")
def lu_heads(spark, sf_dir):
    n = tree(spark, sf_dir, "t1").nodes[2]
    return rounded(h := headtail.pivot_heads(n.df, n.keys, n.features), h.columns)


@query(ctes("t1") + f", h AS (SELECT *, row_number() OVER o AS k, " + ", ".join(f"first_value({c}) OVER o AS h_{c}" for c in _L) + f" FROM v_lineitem WINDOW o AS (PARTITION BY orderkey ORDER BY abs(l_quantity) DESC, {', '.join(_L)})) SELECT orderkey, " + ", ".join(r9(f"{c} - h_{c}", c) for c in _L) + " FROM h WHERE k > 1")
def lu_tails(spark, sf_dir):
    n = tree(spark, sf_dir, "t1").nodes[2]
    return rounded(t := headtail.pivot_tails(n.df, n.keys, n.features), t.columns)


@query(_T4H + ", h AS (SELECT *, row_number() OVER o AS k, first_value(x) OVER o AS hx, first_value(y) OVER o AS hy FROM a WINDOW o AS (PARTITION BY nationkey ORDER BY abs(x) DESC, x, y)) SELECT nationkey, " + r9("x - hx", "c_acctbal") + ", " + r9("y - hy", "o_totalprice") + " FROM h WHERE k > 1")
def lu_gen_tails(spark, sf_dir):
    t = tree(spark, sf_dir, "t4")
    c, o = t.nodes[2], t.nodes[3]
    rows = headtail.aggregate_away(headtail.heads(c.df, c.keys, c.features), c, {"orders": headtail.heads(o.df, o.keys, o.features)})
    return rounded(x := headtail.pivot_tails(rows, c.parent_keys, [*c.features, *o.features]), x.columns)


_T2B = ctes("t2") + """, n AS (SELECT DISTINCT nationkey FROM j),
c AS (SELECT * FROM v_customer WHERE nationkey IN (SELECT nationkey FROM n)), s AS (SELECT * FROM v_supplier WHERE nationkey IN (SELECT nationkey FROM n)),
kc AS (SELECT nationkey, count(*) AS v, sum(c_acctbal) AS t FROM c GROUP BY nationkey), ks AS (SELECT nationkey, count(*) AS v, sum(s_acctbal) AS t FROM s GROUP BY nationkey),
wc AS (SELECT *, row_number() OVER (PARTITION BY nationkey ORDER BY c_acctbal) AS i, sum(c_acctbal) OVER (PARTITION BY nationkey ORDER BY c_acctbal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM c),
ws AS (SELECT *, row_number() OVER (PARTITION BY nationkey ORDER BY s_acctbal) AS i, sum(s_acctbal) OVER (PARTITION BY nationkey ORDER BY s_acctbal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM s)"""


@query(_T2B + " SELECT " + r9("(c_acctbal * (i - 1) - b) / sqrt(i * (i - 1)) * sqrt(ks.v)", "c_acctbal") + ", 0.0 AS s_acctbal FROM wc JOIN ks USING (nationkey) WHERE i > 1 UNION ALL SELECT 0.0, " + r9("(s_acctbal * (i - 1) - b) / sqrt(i * (i - 1)) * sqrt(kc.v)", "s_acctbal") + " FROM ws JOIN kc USING (nationkey) WHERE i > 1 UNION ALL SELECT " + r9("kc.t / sqrt(kc.v) * sqrt(ks.v)", "c") + ", " + r9("ks.t / sqrt(ks.v) * sqrt(kc.v)", "s") + " FROM kc JOIN ks USING (nationkey)")
def block_union(spark, sf_dir):
    t = tree(spark, sf_dir, "t2")
    return rounded(headtail.block_union(headtail.blocks(t), t.features), t.features)


# --- Gram matrices and upper factors ----------------------------------------------------------------------------------


def _gram_sql(name: str, features: Sequence[str], digits: int, per: str = "") -> str:
    cells = [r9(f"sum({a} * {b}){per}", f"g_{i + 1}_{j + 1}", digits) for i, a in enumerate(features) for j, b in enumerate(features) if i <= j]
    return ctes(name) + " SELECT " + ", ".join(cells) + " FROM j"


@query(_gram_sql("t2", ["c_acctbal", "s_acctbal"], 5, " / count(*)"))
def gram_materialized(spark, sf_dir):
    t = tree(spark, sf_dir, "t2")
    rows = relational.materialise(t)
    g = factor.gram_row(rows, t.features).crossJoin(rows.agg(F.count("*").alias("n")))
    return rounded(g.select(*[(F.col(c) / F.col("n")).alias(c) for c in g.columns if c != "n"]), [c for c in g.columns if c != "n"], 5)


@query(_gram_sql("t3", ["l_quantity", "l_extendedprice", "o_totalprice", "c_acctbal", "p_retailprice", "s_acctbal"], 5, " / count(*)"))
def gram_factorized(spark, sf_dir):
    t = tree(spark, sf_dir, "t3")
    g = factor.cofactors(t).crossJoin(counts.join_size(t))
    return rounded(g.select(*[(F.col(c) / F.col("join_rows")).alias(c) for c in g.columns if c != "join_rows"]), [c for c in g.columns if c != "join_rows"], 5)


_CHOL2 = ctes("t2") + ", g AS (SELECT sum(c_acctbal * c_acctbal) AS a, sum(c_acctbal * s_acctbal) AS b, sum(s_acctbal * s_acctbal) AS d FROM j), r AS (SELECT sqrt(a) AS r11, b / sqrt(a) AS r12, sqrt(d - b * b / a) AS r22 FROM g)"
_R2 = _CHOL2 + " SELECT " + ", ".join(r9(c, c, 5) for c in ("r11", "r12", "r22")) + " FROM r"


def _chol_sql(name: str, features: Sequence[str], digits: int) -> str:
    """R of a join by an unrolled Cholesky factorisation."""
    n = len(features)
    parts = [ctes(name) + ", s0 AS (SELECT " + ", ".join(f"sum({features[i]} * {features[j]}) AS g{i + 1}{j + 1}" for i in range(n) for j in range(i, n)) + " FROM j)"]
    for k in range(1, n + 1):
        less = lambda j: "".join(f" - r{m}{k} * r{m}{j}" for m in range(1, k))
        pivot = f"sqrt(g{k}{k}{less(k)})"
        parts.append(f"s{k} AS (SELECT *, {pivot} AS r{k}{k}" + "".join(f", (g{k}{j}{less(j)}) / {pivot} AS r{k}{j}" for j in range(k + 1, n + 1)) + f" FROM s{k - 1})")
    return ", ".join(parts) + " SELECT " + ", ".join(r9(f"r{i}{j}", f"r{i}{j}", digits) for i in range(1, n + 1) for j in range(i, n + 1)) + f" FROM s{n}"


def _register_upper() -> None:
    def on(name, method, factorised):
        def run(spark, sf_dir):
            t = tree(spark, sf_dir, "t2")
            if not factorised:
                t = decompose.single(relational.materialise(t), features=t.features)
            return cells_row(spark, decompose.upper_factor(t, method), "r", digits=5)

        run.__name__ = name
        query(_R2)(run)

    on("qr_r_factorized", "auto", True)
    on("qr_r_heads_tails", "heads_tails", True)
    on("qr_r_cofactor", "cofactor", True)
    on("qr_r_householder", "heads_tails", False)
    on("qr_r_cholesky", "cofactor", False)
    for alias, op in (("qr_r_givens", "QR_GIV_THIN_DIAG"), ("qr_r_sparse", "QR_SPARSE")):

        def run(spark, sf_dir, op=op):
            t = tree(spark, sf_dir, "t2")
            db = Database(spark)
            db.add("joined", relational.materialise(t).select(*t.features))
            hint = {"operator": op, "operands": [{"operator": "relation", "relation": "joined"}]}
            return cells_row(spark, run_query(db, {"query": {"evaluation_hint": hint}}).r, "r", digits=5)

        query(_R2, alias)(run)


_register_upper()


@query(_chol_sql("t3", ["l_quantity", "l_extendedprice", "o_totalprice", "c_acctbal", "p_retailprice", "s_acctbal"], 4))
def qr_r_snowflake(spark, sf_dir):
    return cells_row(spark, decompose.upper_factor(tree(spark, sf_dir, "t3"), "cofactor"), "r", digits=4)


@query(_chol_sql("t4", ["c_acctbal", "o_totalprice", "s_acctbal"], 4))
def qr_r_deep(spark, sf_dir):
    return cells_row(spark, decompose.upper_factor(tree(spark, sf_dir, "t4"), "heads_tails"), "r", digits=4)


@query(_chol_sql("t4", ["c_acctbal", "o_totalprice", "s_acctbal"], 4))
def qr_r_deep_materialized(spark, sf_dir):
    t = tree(spark, sf_dir, "t4")
    return cells_row(spark, decompose.upper_factor(decompose.single(relational.materialise(t), features=t.features), "heads_tails"), "r", digits=4)


@query(_chol_sql("t2", ["c_acctbal", "s_acctbal"], 5))
def qr_r_cholesky_qr2(spark, sf_dir):
    return cells_row(spark, decompose.qr(tree(spark, sf_dir, "t2"), method="cholesky_qr2").r, "r", digits=5)


@query(_chol_sql("t4", ["c_acctbal", "o_totalprice", "s_acctbal"], 4))
def qr_r_deep_auto(spark, sf_dir):
    return cells_row(spark, decompose.upper_factor(tree(spark, sf_dir, "t4"), "auto"), "r", digits=4)


@query(_CHOL2 + " SELECT nationkey, " + r9("c_acctbal / r11", "q1", 8) + ", " + r9("(s_acctbal - c_acctbal / r11 * r12) / r22", "q2", 8) + " FROM j CROSS JOIN r")
def qr_q_factorized(spark, sf_dir):
    q = decompose.qr(tree(spark, sf_dir, "t2"), compute_q=True).rows
    return rounded(q, q.columns, 8)


# --- singular values, principal components ----------------------------------------------------------------------------

_EIG2 = ctes("t2") + """, g AS (SELECT sum(c_acctbal * c_acctbal) AS a, sum(c_acctbal * s_acctbal) AS b, sum(s_acctbal * s_acctbal) AS d FROM j),
e AS (SELECT *, (a + d) / 2 + sqrt(((a - d) / 2) * ((a - d) / 2) + b * b) AS l1, (a + d) / 2 - sqrt(((a - d) / 2) * ((a - d) / 2) + b * b) AS l2 FROM g),
w AS (SELECT *, b / sqrt(b * b + (l1 - a) * (l1 - a)) AS x, (l1 - a) / sqrt(b * b + (l1 - a) * (l1 - a)) AS y FROM e),
z AS (SELECT sqrt(l1) AS s1, sqrt(l2) AS s2,
  CASE WHEN abs(x) >= abs(y) THEN sign(x) ELSE sign(y) END * x AS v11, CASE WHEN abs(x) >= abs(y) THEN sign(x) ELSE sign(y) END * y AS v21,
  CASE WHEN abs(y) >= abs(x) THEN sign(-y) ELSE sign(x) END * (-y) AS v12, CASE WHEN abs(y) >= abs(x) THEN sign(-y) ELSE sign(x) END * x AS v22 FROM w)"""


def _register_singular() -> None:
    sigma = _EIG2 + " SELECT " + r9("s1", "s1", 5) + ", " + r9("s2", "s2", 5) + " FROM z"
    scores = _EIG2 + " SELECT nationkey, " + r9("c_acctbal * v11 + s_acctbal * v21", "p1") + ", " + r9("c_acctbal * v12 + s_acctbal * v22", "p2") + " FROM j CROSS JOIN z"
    for suffix, op in (("divide_conquer", "DIV_AND_CONQ"), ("qr_iter", "QR_ITER"), ("power", "POWER_ITER"), ("eigen", "EIGEN_DECOMP"), ("eigen_dc", "EIGEN_DECOMP_DIV_AND_CONQ"), ("eigen_qr", "EIGEN_DECOMP_QR_ITER"), ("eigen_rrr", "EIGEN_DECOMP_RRR"), ("qr", "QR"), ("factorized", "TREE")):

        def call(spark, sf_dir, kind, op=op, factorised=suffix == "factorized"):
            db, t = Database(spark), tree(spark, sf_dir, "t2")
            if factorised:
                for n in t.nodes:
                    db.add(n.name, n.df.select(*n.keys, *[F.col(f).alias(f.split("__", 1)[1]) for f in n.features]))
                leaf = lambda n: {"operator": "relation", "relation": n}
                operand = {"operator": "natural_join", "central_relation": leaf("nation"), "children": [leaf("customer"), leaf("supplier")]}
            else:
                db.add("joined", relational.materialise(t).select("nationkey", *t.features))
                operand = {"operator": "relation", "relation": "joined"}
            return run_query(db, {"query": {"evaluation_hint": {"operator": f"{kind}_{op}", "operands": [operand], **({} if factorised else {"skip_attributes": ["nationkey"]})}}}, Options())

        query(sigma, f"svd_sigma_{suffix}")(lambda spark, sf_dir, call=call: vector_row(spark, call(spark, sf_dir, "SVD").sigma, "s", 5))

        def score(spark, sf_dir, call=call):
            rows = call(spark, sf_dir, "PCA").rows
            return rounded(rows, ["p1", "p2"])

        query(scores.replace("SELECT nationkey, round", "SELECT round"), f"pca_scores_{suffix}")(score)


_register_singular()


@query(_EIG2 + " SELECT " + ", ".join(r9(c, c, 8) for c in ("v11", "v12", "v21", "v22")) + " FROM z")
def svd_v(spark, sf_dir):
    return cells_row(spark, decompose.svd(tree(spark, sf_dir, "t2")).v, "v", upper=False, digits=8)


@query(_EIG2 + " SELECT nationkey, " + r9("(c_acctbal * v11 + s_acctbal * v21) / s1", "u1", 8) + ", " + r9("(c_acctbal * v12 + s_acctbal * v22) / s2", "u2", 8) + " FROM j CROSS JOIN z")
def svd_u(spark, sf_dir):
    u = decompose.svd(tree(spark, sf_dir, "t2"), compute_u=True).rows
    return rounded(u, u.columns, 8)


_D3 = ["c_acctbal", "o_totalprice", "s_acctbal"]
#: Singular values of a three-column join, by the closed form for the eigenvalues of a symmetric 3 x 3 matrix.
_SIGMA3 = ctes("t4") + """, g AS (SELECT count(*) AS n, avg(c_acctbal * c_acctbal) AS a, avg(o_totalprice * o_totalprice) AS b, avg(s_acctbal * s_acctbal) AS c,
  avg(c_acctbal * o_totalprice) AS d, avg(o_totalprice * s_acctbal) AS e, avg(c_acctbal * s_acctbal) AS f FROM j),
q AS (SELECT *, (a + b + c) / 3 AS q FROM g),
p AS (SELECT *, sqrt(((a - q) * (a - q) + (b - q) * (b - q) + (c - q) * (c - q) + 2 * (d * d + e * e + f * f)) / 6) AS p FROM q),
r AS (SELECT *, acos(((a - q) * ((b - q) * (c - q) - e * e) - d * (d * (c - q) - e * f) + f * (d * e - (b - q) * f)) / (p * p * p) / 2) / 3 AS phi FROM p),
l AS (SELECT q + 2 * p * cos(phi) AS l1, q + 2 * p * cos(phi + 2 * pi() / 3) AS l3, q FROM r)
SELECT """ + r9("sqrt(l1)", "s1", 6) + ", " + r9("sqrt(3 * q - l1 - l3)", "s2", 6) + ", " + r9("sqrt(l3)", "s3", 6) + " FROM l"


def _per_row(spark, sf_dir, found) -> DataFrame:
    """Singular values over the root of the join's size, so that they compare at every scale."""
    n = counts.join_size(tree(spark, sf_dir, "t4")).first()[0]
    return vector_row(spark, found.sigma / np.sqrt(n), "s", 6)


@query(_SIGMA3)
def svd_sigma_deep(spark, sf_dir):
    return _per_row(spark, sf_dir, decompose.svd(tree(spark, sf_dir, "t4")))


@query(_SIGMA3)
def svd_sigma_deep_materialized(spark, sf_dir):
    t = tree(spark, sf_dir, "t4")
    return _per_row(spark, sf_dir, decompose.svd(decompose.single(relational.materialise(t), features=t.features), factor="heads_tails"))


@query(_EIG2 + " SELECT nationkey, " + r9("c_acctbal * v11 + s_acctbal * v21", "p1") + " FROM j CROSS JOIN z")
def pca_half(spark, sf_dir):
    rows = decompose.pca(tree(spark, sf_dir, "t2"), percent=50).rows
    return rounded(rows, rows.columns)


# --- regression, LU ---------------------------------------------------------------------------------------------------

_OLS = ctes("t1") + """, g AS (SELECT sum(l_quantity * l_quantity) AS a, sum(l_quantity * c_acctbal) AS b, sum(c_acctbal * c_acctbal) AS d, sum(l_quantity * o_totalprice) AS p, sum(c_acctbal * o_totalprice) AS q FROM j)
SELECT """ + r9("(q * a - p * b) / (a * d - b * b)", "c_acctbal") + ", " + r9("(p * d - q * b) / (a * d - b * b)", "l_quantity") + " FROM g"


def _regression_tree(spark, sf_dir) -> JoinTree:
    shape, _ = TREES["t1"]
    t = tree(spark, sf_dir, "t1")
    own = lambda n: n.df.select(*n.keys, *[F.col(f).alias(f.split("__", 1)[1]) for f in n.features])
    return JoinTree(shape, {n.name: own(n) for n in t.nodes}, skip=["l_extendedprice", "l_discount"])


def _coefficients(spark, found) -> DataFrame:
    x = {k.split("__", 1)[1]: round(v, 9) + 0.0 for k, v in found.coefficients.items()}
    return spark.createDataFrame([(x["c_acctbal"], x["l_quantity"])], "c_acctbal double, l_quantity double")


@query(_OLS)
def lin_reg_factorized(spark, sf_dir):
    return _coefficients(spark, decompose.linear_regression(_regression_tree(spark, sf_dir), "o_totalprice", "cofactor"))


@query(_OLS)
def lin_reg_materialized(spark, sf_dir):
    t = _regression_tree(spark, sf_dir)
    rows = relational.materialise(t).select(*t.features)
    flat = rows.select(*[F.col(f).alias(f.split("__", 1)[1]) for f in t.features])
    return _coefficients(spark, decompose.linear_regression(JoinTree("A", {"A": flat}), "o_totalprice"))


@query(_OLS)
def lls_qr(spark, sf_dir):
    return _coefficients(spark, decompose.least_squares(_regression_tree(spark, sf_dir), "o_totalprice"))


_LU2 = ctes("t2") + """, p AS (SELECT c_acctbal AS u11, s_acctbal AS u12 FROM j ORDER BY abs(c_acctbal) DESC, c_acctbal DESC, s_acctbal DESC LIMIT 1),
d AS (SELECT s_acctbal - c_acctbal / u11 * u12 AS u22 FROM j CROSS JOIN p ORDER BY abs(s_acctbal - c_acctbal / u11 * u12) DESC LIMIT 1)"""
_LU2_SQL = _LU2 + " SELECT " + r9("u11", "u11") + ", " + r9("u12", "u12") + ", " + r9("u22", "u22") + " FROM p CROSS JOIN d"


@query(_LU2_SQL)
def lu_u_factorized(spark, sf_dir):
    return cells_row(spark, decompose.lu(tree(spark, sf_dir, "t2")).u, "u")


def _register_lu() -> None:
    for name, op in (("lu_lapack", "LU_LAPACK"), ("lu_thin", "LU_THIN")):

        def run(spark, sf_dir, op=op):
            t, db = tree(spark, sf_dir, "t2"), Database(spark)
            db.add("joined", relational.materialise(t).select(*t.features))
            return cells_row(spark, run_query(db, {"query": {"evaluation_hint": {"operator": op, "operands": [{"operator": "relation", "relation": "joined"}]}}}).u, "u")

        query(_LU2_SQL, name)(run)


_register_lu()


@query(_LU2 + " SELECT nationkey, " + r9("c_acctbal / u11", "l1") + ", " + r9("(s_acctbal - c_acctbal / u11 * u12) / u22", "l2") + " FROM j CROSS JOIN p CROSS JOIN d")
def lu_l_factorized(spark, sf_dir):
    rows = decompose.lu(tree(spark, sf_dir, "t2"), compute_l=True).rows
    return rounded(rows, rows.columns)


_BY = "ORDER BY abs({0}) DESC, {0} DESC, c_acctbal DESC, o_totalprice DESC, s_acctbal DESC LIMIT 1"
_LU3 = ctes("t4") + f""", p1 AS (SELECT c_acctbal AS u11, o_totalprice AS u12, s_acctbal AS u13 FROM j {_BY.format("c_acctbal")}),
d1 AS (SELECT *, o_totalprice - c_acctbal / u11 * u12 AS b, s_acctbal - c_acctbal / u11 * u13 AS c FROM j CROSS JOIN p1),
p2 AS (SELECT b AS u22, c AS u23 FROM d1 {_BY.format("b")}),
p3 AS (SELECT c - b / u22 * u23 AS u33 FROM d1 CROSS JOIN p2 ORDER BY abs(c - b / u22 * u23) DESC, c - b / u22 * u23 DESC LIMIT 1)"""


@query(_LU3 + " SELECT " + ", ".join(r9(c, c, 8) for c in ("u11", "u12", "u13", "u22", "u23", "u33")) + " FROM p1 CROSS JOIN p2 CROSS JOIN p3")
def lu_u_deep(spark, sf_dir):
    return cells_row(spark, decompose.lu(tree(spark, sf_dir, "t4")).u, "u", digits=8)


@query(
    "WITH a AS (SELECT c_acctbal / 1e4 AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer), p AS (SELECT x AS u11, 2 * x AS u12, y AS u13 FROM a ORDER BY abs(x) DESC, x DESC, y DESC LIMIT 1), "
    "d AS (SELECT y - x / u11 * u13 AS u33 FROM a CROSS JOIN p ORDER BY abs(y - x / u11 * u13) DESC LIMIT 1) SELECT " + ", ".join(r9(c, c) for c in ("u11", "u12", "u13", "0.0", "u33")).replace("AS 0.0", "AS u22") + ", 0.0 AS u23 FROM p CROSS JOIN d"
)
def lu_rank_deficient(spark, sf_dir):
    """The second column is twice the first: a zero pivot."""
    x = F.col("c_acctbal") / 1e4
    rows = table(spark, sf_dir, "customer").select(x.alias("x"), (2 * x).alias("x2"), F.col("c_nationkey").cast("double").alias("y"))
    return cells_row(spark, decompose.lu(decompose.single(rows)).u, "u")


@query(
    ctes("t2") + """, p AS (SELECT * FROM j ORDER BY abs(c_acctbal) DESC, c_acctbal DESC, s_acctbal DESC, nationkey DESC LIMIT 1),
d AS (SELECT j.*, j.s_acctbal - j.c_acctbal / p.c_acctbal * p.s_acctbal AS r FROM j CROSS JOIN p),
q AS (SELECT * FROM d ORDER BY abs(r) DESC, r DESC, c_acctbal DESC, s_acctbal DESC, nationkey DESC LIMIT 1)
SELECT CAST(1 AS INTEGER) AS step, nationkey, """ + r9("c_acctbal", "c_acctbal") + ", " + r9("s_acctbal", "s_acctbal") + " FROM p UNION ALL SELECT 2, nationkey, " + r9("c_acctbal", "c") + ", " + r9("s_acctbal", "s") + " FROM q"
)
def lu_permutation(spark, sf_dir):
    """The pivot rows of a join in their order: join attributes and values."""
    f = decompose.lu(tree(spark, sf_dir, "t2"))
    rows = [(i + 1, k["nationkey"], *(round(float(x), 9) + 0.0 for x in row)) for i, (k, row) in enumerate(zip(f.pivot_keys, f.pivots))]
    return spark.createDataFrame(rows, "step int, nationkey long, c_acctbal double, s_acctbal double")


# --- dense kernels ------------------------------------------------------------------------------------------------------

_BACK = _chol_sql("t4", _D3[::-1], 4)


def _register_kernels() -> None:
    """The factor of the join with its columns in reverse, by each kernel from the factor in order."""
    for name, kernel in (("givens", linalg.givens_upper), ("gram_schmidt", lambda a: linalg.positive_diagonal(linalg.gram_schmidt(a)[1])), ("householder", lambda a: linalg.householder_qr(a)[1])):
        query(_BACK, f"kernel_{name}")(lambda spark, sf_dir, kernel=kernel: cells_row(spark, kernel(decompose.upper_factor(tree(spark, sf_dir, "t4"))[:, ::-1]), "r", digits=4))


_register_kernels()


@query(
    ctes("t4") + ", g AS (SELECT " + ", ".join(f"avg({a} * {b}) AS g{i + 1}{k + 1}" for i, a in enumerate(_D3) for k, b in enumerate(_D3) if i <= k) + " FROM j), e AS (SELECT *, g22 - g12 * g12 / g11 AS h22, g23 - g12 * g13 / g11 AS h23, g33 - g13 * g13 / g11 AS h33 FROM g) SELECT "
    + ", ".join(r9(x, f"u{n}", 6) for x, n in (("g11", 11), ("g12", 12), ("g13", 13), ("h22", 22), ("h23", 23), ("h33 - h23 * h23 / h22", 33))) + " FROM e"
)
def kernel_elimination(spark, sf_dir):
    """U of the Gram matrix by elimination with the first non-zero pivot."""
    t = tree(spark, sf_dir, "t4")
    return cells_row(spark, linalg.lu_first_pivot(factor.factorised_gram(t) / counts.join_size(t).first()[0]), "u", digits=6)


# --- matrix arithmetic and checks ---------------------------------------------------------------------------------------


def _keyed(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_retailprice") / 1000).alias("x"), F.col("p_size").cast("double").alias("y"))


_K = "WITH a AS (SELECT p_partkey AS k, p_retailprice / 1000 AS x, CAST(p_size AS DOUBLE) AS y FROM part)"


@query(_K + " SELECT k, " + r9("x + 2 * x", "x") + ", " + r9("y + 3 * y", "y") + " FROM a")
def mat_add(spark, sf_dir):
    a = _keyed(spark, sf_dir)
    return rounded(s := matrix.add(a, matrix.multiply_diagonal(a, [2, 3], ["k"]), ["k"]), s.columns)


@query(_K + " SELECT k, " + r9("x - 2 * x", "x") + ", " + r9("y - 3 * y", "y") + " FROM a")
def mat_subtract(spark, sf_dir):
    a = _keyed(spark, sf_dir)
    return rounded(s := matrix.subtract(a, matrix.multiply_diagonal(a, [2, 3], ["k"]), ["k"]), s.columns)


@query(_K + " SELECT k, " + r9("x + 3 * y", "c1") + ", " + r9("2 * x - y", "c2") + " FROM a")
def mat_multiply(spark, sf_dir):
    return rounded(m := matrix.multiply(_keyed(spark, sf_dir), np.array([[9.0, 9.0], [1.0, 2.0], [3.0, -1.0]]), ["k"], start=1), m.columns)


@query(_K + " SELECT " + r9("sum(x * x) / count(*)", "p_1_1", 5) + ", " + r9("sum(x * y) / count(*)", "p_1_2", 5) + ", " + r9("sum(y * x) / count(*)", "p_2_1", 5) + ", " + r9("sum(y * y) / count(*)", "p_2_2", 5) + " FROM a")
def mat_multiply_t(spark, sf_dir):
    a = _keyed(spark, sf_dir)
    n = a.count()
    p = matrix.multiply_transpose(a, a, ["k"])
    return rounded(p.select(*[(F.col(c) / n).alias(c) for c in p.columns]), p.columns, 5)


@query(_K + " SELECT k, " + r9("x", "x") + ", CASE WHEN y >= 10 THEN y ELSE -1 END AS y FROM a")
def mat_beside(spark, sf_dir):
    """Horizontal concatenation; rows that one side lacks are padded with -1."""
    a = _keyed(spark, sf_dir)
    return rounded(m := matrix.beside(a.select("k", "x"), a.where("y >= 10").select("k", "y"), ["k"], -1.0), m.columns)


@query(_K + " SELECT " + r9("x", "x") + ", 0.0 AS y FROM a UNION ALL SELECT 0.0, y FROM a")
def mat_below(spark, sf_dir):
    """Vertical concatenation; columns that one side lacks are padded with zero."""
    a = _keyed(spark, sf_dir)
    return rounded(m := matrix.below(a.select("x"), a.select("y")), m.columns)


@query(_K + " SELECT k, " + r9("x * 2", "x") + ", " + r9("y * 0.5", "y") + " FROM a")
def mat_rect_diag(spark, sf_dir):
    return rounded(m := matrix.multiply_diagonal(_keyed(spark, sf_dir), [2, 0.5], ["k"]), m.columns)


@query(_K + " SELECT " + r9("sum(x * x) / count(*)", "g_1_1", 5) + ", " + r9("sum(x * y) / count(*)", "g_1_2", 5) + ", " + r9("sum(y * y) / count(*)", "g_2_2", 5) + " FROM a")
def self_multiply(spark, sf_dir):
    a = _keyed(spark, sf_dir)
    n = a.count()
    g = factor.gram_row(a, ["x", "y"])
    return rounded(g.select(*[(F.col(c) / n).alias(c) for c in g.columns]), g.columns, 5)


@query(_K + " SELECT " + r9("sqrt(sum(x * x + y * y) / count(*))", "norm") + " FROM a")
def fro_norm(spark, sf_dir):
    a = _keyed(spark, sf_dir)
    n = a.count()
    return rounded(matrix.frobenius(a, ["k"]).select((F.col("norm") / F.lit(float(n)) ** 0.5).alias("norm")), ["norm"])


@query(_EIG2 + " SELECT " + r9("s1 / s2", "cond") + " FROM z")
def cond_number(spark, sf_dir):
    return spark.createDataFrame([(round(linalg.condition_number(decompose.upper_factor(tree(spark, sf_dir, "t2"))), 9),)], "cond double")


@query("SELECT 0.0 AS error")
def orthogonality_q(spark, sf_dir):
    q = decompose.qr(tree(spark, sf_dir, "t2"), compute_q=True).rows
    return spark.createDataFrame([(round(matrix.orthogonality(q, ["q1", "q2"]), 9) + 0.0,)], "error double")


@query("SELECT 0.0 AS error")
def qr_residual(spark, sf_dir):
    t = tree(spark, sf_dir, "t2")
    f = decompose.qr(t)
    from .operators.rightmul import right_multiply

    rows = right_multiply(t, linalg.inverse(f.r), "q", keep_features=True)
    return spark.createDataFrame([(round(matrix.residual(rows, t.features, ["q1", "q2"], f.r), 9) + 0.0,)], "error double")


@query(_chol_sql("t2", ["c_acctbal", "s_acctbal"], 5).split(" SELECT round")[0] + " SELECT " + r9("1 / r11", "i11", 8) + ", " + r9("-r12 / (r11 * r22)", "i12", 8) + ", " + r9("1 / r22", "i22", 8) + " FROM s2")
def inverse_r(spark, sf_dir):
    return cells_row(spark, linalg.inverse(decompose.upper_factor(tree(spark, sf_dir, "t2"))), "i", digits=8)


# --- sources and sinks --------------------------------------------------------------------------------------------------


@query("SELECT s_suppkey AS k, " + r9("s_acctbal", "x", 4) + " FROM supplier")
def csv_roundtrip(spark, sf_dir):
    path = scratch(spark, "csv")
    write_csv(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("double").alias("k"), F.col("s_acctbal").alias("x")), path)
    db = Database.from_config(spark, {"database": {"relations": [{"name": "s", "data_path": path, "attributes": [{"name": "k", "type": "double"}, {"name": "x", "type": "double"}]}]}})
    return rounded(db.load("s").select(F.col("k").cast("bigint").alias("k"), "x"), ["k", "x"], 4)


def _database(spark, sf_dir) -> Database:
    """Supplier and nation by a schema, from their Parquet files."""
    attributes = lambda **kinds: [{"name": n, "type": k} for n, k in kinds.items()]
    return Database.from_config(spark, {"database": {"relations": [
        {"name": "supplier", "data_path": f"{sf_dir}/supplier.parquet", "primary_key": ["s_suppkey"], "attributes": attributes(s_suppkey="int", s_nationkey="category", s_acctbal="double")},
        {"name": "nation", "data_path": f"{sf_dir}/nation.parquet", "primary_key": ["n_nationkey"], "attributes": attributes(n_nationkey="int", n_regionkey="category")},
    ]}}).load_all()


@query(" UNION ALL ".join(f"SELECT '{r}' AS relation, count(*) AS n_rows, CAST({c} AS INTEGER) AS n_columns, count(*) * {c} AS n_values, count(*) * {8 * c} AS n_bytes FROM {r}" for r, c in (("nation", 2), ("supplier", 3))))
def load_all_report(spark, sf_dir):
    return _database(spark, sf_dir).report()


@query("SELECT s_suppkey, CAST(s_nationkey AS BIGINT) AS s_nationkey, " + r9("s_acctbal", "s_acctbal", 4) + " FROM supplier")
def load_parquet(spark, sf_dir):
    return rounded(df := _database(spark, sf_dir).load("supplier"), df.columns, 4)


@query("SELECT * FROM (VALUES ('supplier', 's_nationkey'), ('nation', 'n_regionkey')) t(relation, attribute)")
def category_lists(spark, sf_dir):
    return spark.createDataFrame([(n, c) for n, s in _database(spark, sf_dir).schemas.items() for c in s.categories], "relation string, attribute string")


@query("SELECT * FROM (VALUES ('supplier', 's_suppkey', 'int'), ('supplier', 's_nationkey', 'category'), ('supplier', 's_acctbal', 'double'), ('nation', 'n_nationkey', 'int'), ('nation', 'n_regionkey', 'category')) t(relation, attribute, kind)")
def config_roundtrip(spark, sf_dir):
    again = Database.from_config(spark, _database(spark, sf_dir).config())
    return spark.createDataFrame([(s.name, a.name, a.kind) for s in again.schemas.values() for a in s.attributes], "relation string, attribute string, kind string")


@query("SELECT count(*) AS n_rows, CAST(sum(n_nationkey) AS BIGINT) AS keys FROM nation")
def table_roundtrip(spark, sf_dir):
    """Relations saved as catalog tables, read back and dropped."""
    import uuid

    db = Database(spark)
    db.add("nation", _database(spark, sf_dir).relations["nation"])
    names = db.save_tables(f"treefold_{uuid.uuid4().hex}_")
    try:
        row = db.load_table(names[0], "again").agg(F.count("*").alias("n_rows"), F.sum("n_nationkey").alias("keys")).first()
    finally:
        db.drop_tables(names)
    return spark.createDataFrame([tuple(row)], "n_rows long, keys long")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def rename_and_copy(spark, sf_dir):
    db = _database(spark, sf_dir)
    db.rename("nation", "land")
    name = db.copy("land")
    db.drop("land")
    return db.memory_layout("column_major").relations[name]


@query(ctes("t2") + " SELECT count(*) AS join_rows FROM j WHERE c_acctbal > 0")
def recount_after_change(spark, sf_dir):
    """The same tree over other rows: nothing that was computed before is reused."""
    t = tree(spark, sf_dir, "t2")
    counts.join_size(t).first()
    return counts.join_size(t.with_frames({"customer": t.nodes[1].df.where("customer__c_acctbal > 0")}))


@query("SELECT s_suppkey, s_nationkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def natural_join_two(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return relational.natural_join(s.select("s_suppkey", "s_nationkey"), n.select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")).select("s_suppkey", "s_nationkey", "n_regionkey")


@query("SELECT CAST(4 * (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS BIGINT) AS cost")
def reduced_size(spark, sf_dir):
    t = tree(spark, sf_dir, "t2")
    return spark.createDataFrame([(plans_tree.reduced_size(t, {n.name: n.df.count() for n in t.nodes}),)], "cost long")


@query("SELECT n_nationkey, n_regionkey FROM nation")
def shuffled_relation(spark, sf_dir):
    return relational.shuffled(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))


@query(ctes("t2") + ", d AS (SELECT nationkey, c_acctbal, s_acctbal FROM j), t AS (SELECT * FROM d ORDER BY nationkey DESC, c_acctbal DESC, s_acctbal DESC LIMIT (SELECT CAST(floor(count(*) * 0.05) AS BIGINT) FROM d)) SELECT nationkey, " + r9("c_acctbal", "c_acctbal") + " FROM v_customer WHERE (nationkey, c_acctbal) IN (SELECT (nationkey, c_acctbal) FROM t)")
def reduce_to_top(spark, sf_dir):
    """The customers that take part in the top twentieth of the join."""
    t = tree(spark, sf_dir, "t2")
    n = relational.reduce_to(t, relational.top_fraction(relational.materialise(t), 0.05)).nodes[1]
    return rounded(n.df, [*n.keys, *n.features])


@query("SELECT count(*) AS n_rows, true AS inside, true AS even FROM customer")
def shrink_domain(spark, sf_dir):
    """Nation keys mapped onto eight codes: all within the domain, equal keys to equal codes."""
    df = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("code"), F.col("c_nationkey").alias("key"))
    codes = relational.shrink_domain(df, "code", 8)
    per = codes.groupBy("key").agg(F.count("*").alias("n"), F.min("code").alias("low"), F.max("code").alias("high"))
    return per.agg(F.sum("n").alias("n_rows"), F.expr("min(low) >= 0 and max(high) < 8").alias("inside"), F.expr("bool_and(low = high)").alias("even"))


@query("SELECT CAST(1000 AS BIGINT) AS n_rows, true AS inside")
def uniform_relation(spark, sf_dir):
    df = generators.uniform_relation(spark, 1000, 2, {"k": 10, "m": 3}, low=-1.0, high=1.0)
    return df.agg(F.count("*").alias("n_rows"), F.expr("min(k) >= 1 and max(k) <= 10 and min(m) >= 1 and max(m) <= 3 and min(A1) >= -1 and max(A2) < 1").alias("inside"))


@query("SELECT CAST(1200 AS BIGINT) AS join_rows")
def generated_pair(spark, sf_dir):
    a, b = generators.cartesian_pair(spark, (40, 30), (2, 2))
    return relational.natural_join(a, b).agg(F.count("*").alias("join_rows"))


@query("SELECT 0.0 AS error, true AS same")
def compare_factors(spark, sf_dir):
    """R without the join against R of the join."""
    t = tree(spark, sf_dir, "t3")
    error, same = matrix.compare_factors(decompose.upper_factor(t, "heads_tails"), decompose.upper_factor(decompose.single(relational.materialise(t), features=t.features), "heads_tails"), 9)
    return spark.createDataFrame([(round(error, 9) + 0.0, same)], "error double, same boolean")


@query("SELECT * FROM (VALUES ('lineitem__l_quantity'), ('orders__o_totalprice'), ('part__p_retailprice')) t(feature)")
def alternate_features(spark, sf_dir):
    t = tree(spark, sf_dir, "t3")
    return spark.createDataFrame([(f,) for f in relational.alternate_features(t.features, "supplier__s_acctbal")], "feature string")


@query("SELECT * FROM (VALUES ('counts', CAST(2 AS BIGINT)), ('factor', CAST(1 AS BIGINT))) t(phase, runs)")
def phase_timers(spark, sf_dir):
    timers, t = Timers(), tree(spark, sf_dir, "t2")
    for _ in range(2):
        with timers.phase("counts"):
            counts.join_size(t).first()
    with timers.phase("factor"):
        decompose.upper_factor(t)
    if min(timers.means().values()) <= 0:
        raise ValueError("a phase took no time")
    return spark.createDataFrame([(p, len(s)) for p, s in timers.seconds.items()], "phase string, runs long")


@query(_chol_sql("t2", ["c_acctbal", "s_acctbal"], 5).split(" SELECT round")[0] + " SELECT CAST(1 AS INTEGER) AS i, CAST(1 AS INTEGER) AS j, " + r9("r11", "value", 5) + " FROM s2 UNION ALL SELECT 1, 2, " + r9("r12", "value", 5) + " FROM s2 UNION ALL SELECT 2, 1, 0.0 FROM s2 UNION ALL SELECT 2, 2, " + r9("r22", "value", 5) + " FROM s2")
def dumped_factor(spark, sf_dir):
    """R of a JSON query over Parquet files, as the command line dumps it."""
    import json

    from .__main__ import main

    attributes = lambda *names: [{"name": n, "type": "double" if n.endswith("acctbal") else "int"} for n in names]
    home, frames = scratch(spark, "dump"), tree(spark, sf_dir, "t2").nodes
    for n in frames:
        n.df.select(*n.keys, *[F.col(f).alias(f.split("__", 1)[1]) for f in n.features]).write.parquet(f"{home}/{n.name}.parquet")
    relations = [{"name": n.name, "data_path": f"{n.name}.parquet", "attributes": attributes(*n.keys, *(f.split("__", 1)[1] for f in n.features))} for n in frames]
    leaf = lambda n: {"operator": "relation", "relation": n}
    hint = {"operator": "QR_TREE", "operands": [{"operator": "natural_join", "central_relation": leaf("nation"), "children": [leaf("customer"), leaf("supplier")]}]}
    main([json.dumps({"database": {"relations": relations}}), json.dumps({"query": {"evaluation_hint": hint}}), "--base", home, "--dump", f"{home}/out"])
    rows = spark.read.csv(f"{home}/out/r", schema="i double, j double, value double")
    return rounded(rows.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "value"), ["i", "j", "value"], 5)


@query("SELECT count(*) AS n_rows FROM orders")
def row_count(spark, sf_dir):
    db = Database(spark)
    db.add("orders", table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"))
    return db.relations["orders"].agg(F.count("*").alias("n_rows"))


@query()
def random_normal(spark, sf_dir):
    return random_relation(spark, 1000, 3)


@query("SELECT CAST(0.0 AS DOUBLE) AS error")
def known_factor(spark, sf_dir):
    x, y, r = generators.known_factor_pair(spark, (64, 32), 4)
    got = decompose.upper_factor(JoinTree(("X", "Y"), {"X": x, "Y": y}))
    return spark.createDataFrame([(round(float(np.abs(got[:4, :4] - r).max()), 9) + 0.0,)], "error double")
